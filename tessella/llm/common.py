"""Helpers shared by the operators: the shared folder, lineage cuts, Arrow access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many bytes may be broadcast; larger ones are joined by a shuffle.
BROADCAST_LIMIT = 64 << 20
#: Rows whose texts are Python values at the same time.
SLICE_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode, where driver and tasks are one process on one machine, a temporary one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessella-checkpoints-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``, the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def attached(rows: DataFrame, small: DataFrame, on: list[str], salt: str | None = None, salts: int = 64, limit: int = BROADCAST_LIMIT, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small`` on equal columns ``on``, nulls included.

    ``small`` is broadcast where its measured size allows, so no key is dealt
    out.  Beyond that both sides are shuffled; a key that many rows may share
    is split by a hash of column ``salt``.
    """
    text = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in on]
    size = small.agg(F.sum(sum(text, F.lit(16 * len(small.columns) + 32)))).first()[0] or 0
    rest = [c for c in small.columns if c not in on]
    other = small.select(*[F.col(c).alias(f"{c} of small") for c in on], *rest)
    same = [F.col(c).eqNullSafe(F.col(f"{c} of small")) for c in on]
    if size <= limit:
        found = rows.join(F.broadcast(other), same, how)
    elif salt is None:
        found = rows.join(other, same, how)
    else:
        other = other.withColumn("salt of small", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = rows.join(other, [*same, F.pmod(F.xxhash64(salt), F.lit(salts)) == F.col("salt of small")], how)
    return found.select(*rows.columns, *rest)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a task holds the Python values of so many texts only."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def byte_values(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each string of an Arrow column without decoding it; None for null."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()
