"""A whole audit in one look at each text: flags, the hash of its normal form, and whether the benchmark has part of it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, WHITE
from ..joins import dealt_out, joined, scratch
from . import decontam
from .quality import SHORT, audit

_CJK = re.compile(CJK)
MARKS = "q1_empty boolean, q2_short boolean, q_cjk boolean, hit boolean, hash string"


def marked(rows: DataFrame, bench: DataFrame, key: str, by: list[str], sides: list[str], digits: int = 16, n: int = decontam.N, limit: int = decontam.BROADCAST_LIMIT) -> DataFrame:
    """(key, by, MARKS) of each row: whether a side is empty, short but not empty, or has CJK characters, whether one shares an n-gram with ``bench`` (text), and the hash of the normal form of the first side. Null texts are empty ones."""
    index, known = decontam.indexed(bench, n, limit)
    kinds = dict(rows.dtypes)
    kept = [key, *by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = decontam.Hashes()
        grams, wanted = known.value if known else (frozenset(), np.empty(0, dtype=np.uint64))
        for batch in batches:
            out: list[tuple] = []
            for texts in zip(*(c.to_pylist() for c in batch.columns[len(kept) :]), strict=True):
                texts = [t or "" for t in texts]
                sizes = [len(t.strip(WHITE)) for t in texts]
                words = [decontam.normal_words(t) for t in texts]
                hit = False
                for w in words:
                    if len(w) >= n and len(wanted):
                        at = np.flatnonzero(decontam.near(wanted, hashes.windows(w, n)))
                        hit = hit or any(" ".join(w[k : k + n]) in grams for k in at)
                empty = not all(sizes)
                form = hashlib.sha256(" ".join(words[0]).encode()).hexdigest()[:digits]
                out.append((empty, not empty and min(sizes) < SHORT, any(map(_CJK.search, texts)), hit, form))
            marks = [pa.array([r[k] for r in out], pa.bool_()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *marks, pa.array([r[4] for r in out], pa.string())], [*kept, *(m.split()[0] for m in MARKS.split(", "))])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), MARKS])
    found = dealt_out(rows.select(*kept, *[F.col(s).alias(f"_side_{s}") for s in sides])).mapInArrow(run, schema)
    if known:
        return found
    hits = decontam.side_hits(rows, bench, key, sides, n, limit).where(F.size("hits") > 0).select(F.col("key").alias(key), F.lit(True).alias("_hit")).distinct()
    return found.join(hits, key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def audited(rows: DataFrame, bench: DataFrame, key: str, by: list[str], sides: list[str], **more) -> DataFrame:
    """``quality.audit`` of the flags, duplicates of the first side (all but the first key of a hash) and n-gram hits of ``rows``. Texts are read once; what follows is a short row each, stored in the shared folder."""
    spark = rows.sparkSession
    paths = [scratch(spark, name) for name in ("audit-marks", "audit-hashes")]
    marked(rows, bench, key, by, sides, **more).write.parquet(paths[0])
    marks = spark.read.parquet(paths[0])
    marks.groupBy("hash").agg(F.min(key).alias("first_key"), F.count("*").alias("_n")).write.parquet(paths[1])
    found = joined(marks, spark.read.parquet(paths[1]), "hash", "_n", key)
    return audit(found.withColumn("is_duplicate", F.col(key) > F.col("first_key")), by, "hit")
