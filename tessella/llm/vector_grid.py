"""Searching all vectors for a stated query set: a shard is indexed once, and all queries stream past it.

Every vector is sent to one shard and every query to each, sorted so that a
task has a shard's vectors first and then the queries, of which it holds a batch
at a time; the best of all shards are merged by Spark.  Vectors are dealt by a
hash of their id, so shards are even whatever repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a shard: n / SHARDS, but within these limits.
SHARDS, LEAST_ROWS, MOST_ROWS = 32, 500, 200_000


def usable(vectors: DataFrame, key: str, embedding: str, zero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose id and vector are there and finite; ``zero``: all-zero vectors stay."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(finite if zero else finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width))
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(out) and (lengths == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(out), width)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[k, : b - a] = values[a:b]
    return out


def search(vectors: DataFrame, is_query: Column, k: int, ascending: bool, kind: str, index: Callable) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of the shards' answers, ties to the smaller vec_id.

    ``index(ids, matrix)`` is made once for each shard; its ``answers(query_ids,
    query_matrix)`` yields (query_id, vec_ids, scores).
    """
    vectors = cut(vectors)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-n // max(LEAST_ROWS, min(MOST_ROWS, n // SHARDS))))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    held = vectors.select(shard.alias("shard"), F.lit(0).alias("asks"), "vec_id", "v")
    asking = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "v")
    number = {"long": pa.int64(), "double": pa.float64()}[kind]

    def answered(found: object, ids: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        for query, vec_ids, scores in found.answers(ids, asked):
            for column, values in zip(out, (np.full(len(vec_ids), query), vec_ids, scores), strict=True):
                column.append(values)
        joined = [np.concatenate(c) if c else [] for c in out]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(joined, (pa.int64(), pa.int64(), number), strict=True)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = -1, None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            of, asks = (batch.column(c).to_numpy() for c in (0, 1))
            starts = np.flatnonzero(np.diff(2 * of.astype(np.int64) + asks, prepend=-1))
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                some = batch.slice(start, end - start)
                if of[start] != at:
                    at, made, parts = of[start], None, []
                ids, rows = some.column(2).to_numpy(), matrix(some.column(3), width)
                if not asks[start]:
                    parts.append((ids, rows))
                elif made is not None or parts:
                    if made is None:
                        made, parts = index(*map(np.concatenate, zip(*parts, strict=True))), []
                    yield answered(made, ids, rows)

    # twice as many partitions as shards: few of them share one
    streams = held.unionByName(asking).repartition(2 * shards, "shard").sortWithinPartitions("shard", "asks", "vec_id")
    found = streams.mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").asc() if ascending else F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
