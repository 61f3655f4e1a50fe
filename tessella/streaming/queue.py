"""The pending queue as a stream: files of answers are graded and merged in micro-batches.

The file source's log and the checkpoint give every file to one batch once, and
batches that fail in the middle run again, so the merge must be (and is)
idempotent.  Rows that can't be graded go to a dead-letter table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import Versioned

ANSWERS = "model string, corpus string, pair_id string, side string, answer string, reference string, category string, difficulty string, timestamp string"


def pending(spark: SparkSession, path: str, schema: str = ANSWERS, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files_per_batch).json(path)


def grade_into(stream: DataFrame, results: Versioned, failed: str, grade: Callable[[DataFrame], DataFrame], keys: list[str], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Grade each batch and upsert it by ``keys`` and timestamp; ``interval`` polls forever, else what is there is taken and the query ends."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        bad = F.col("_corrupt_record").isNotNull() | F.col("model").isNull() | F.col("corpus").isNull() | F.col("pair_id").isNull()
        # the batch's own folder: a batch that runs again replaces what it wrote
        rows.where(bad).write.mode("overwrite").json(f"{failed}/batch={number}")
        good = rows.where(~bad).drop("_corrupt_record")
        if not good.isEmpty():
            results.upsert(grade(good), keys, "timestamp")
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def new_keys(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """The first row of every key; keys are forgotten ``delay`` after their time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, size: str, delay: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts per event-time window: an extension beyond the queue."""
    window = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    return stream.withWatermark(event_time, delay).groupBy(window.alias("window"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
