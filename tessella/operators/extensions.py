"""Extension points that SQL can call: statistics over groups and generators over seeds.

``register_statistic`` takes a plain function of arrays and makes it an
aggregate; ``register_generator`` takes a plain function of a seed's columns
and makes it a table function.  An aggregate of this kind sees its whole group
in one task: for groups without a bound use the sums of ``resampling``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_statistic(spark: SparkSession, name: str, statistic: Callable[..., float]) -> None:
    """SQL function ``name(x, ...)``: ``statistic`` of the group's rows without a null, as arrays; null for NaN, for no rows and where it fails on what it is given by a ZeroDivisionError or ValueError."""

    def of_group(*columns: pa.Array) -> float | None:
        whole = np.ones(len(columns[0]), dtype=bool)
        for c in columns:
            whole &= np.asarray(c.is_valid())
        values = [c.filter(pa.array(whole)).to_numpy(zero_copy_only=False) for c in columns]
        try:
            found = float(statistic(*values)) if whole.any() else np.nan
        except (ZeroDivisionError, ValueError):
            return None
        return None if np.isnan(found) else found

    spark.udf.register(name, F.arrow_udf(of_group, "double", F.ArrowUDFType.GROUPED_AGG))


def register_generator(spark: SparkSession, name: str, create: Callable[..., Iterable[tuple]], columns: str) -> None:
    """SQL table function ``name(...)`` with ``columns``: the rows that ``create`` gives for one call's arguments; used with LATERAL it makes a seed's candidates."""

    class Generator:
        def eval(self, *arguments: Any) -> Iterable[tuple]:
            yield from create(*arguments)

    spark.udtf.register(name, F.udtf(Generator, returnType=columns))
