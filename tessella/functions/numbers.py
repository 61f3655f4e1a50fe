"""Numeric expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exclusive_quantile(values: Column, i: int, n: int = 10) -> Column:
    """The i-th of n - 1 exclusive quantiles of a sorted array: position i (size + 1) / n, interpolated."""
    size = F.size(values)
    place = F.lit(i) * (size + 1)
    j = F.least(F.greatest(F.floor(place / n), F.lit(1)), size - 1).cast("int")
    delta = place - j * n
    return (F.try_element_at(values, j) * (n - delta) + F.try_element_at(values, j + 1) * delta) / n


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; ``empty`` (null by default) where the whole is 0."""
    found = F.try_divide(part.cast("double"), whole.cast("double"))
    return found if empty is None else F.coalesce(found, F.lit(float(empty)))


def not_nan(value: Column) -> Column:
    """NaN means missing: null."""
    return F.when(~F.isnan(value), value)


def order_key(*parts: Column, seed: int = 0) -> Column:
    """A seeded order that any engine can recompute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
