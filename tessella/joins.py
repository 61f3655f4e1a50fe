"""Joins that stay even when a few keys hold much of the rows, and a shared folder for what is written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def joined(rows: DataFrame, table: DataFrame, key: str, n: str, spread: str, heavy: int = 1024) -> DataFrame:
    """``rows`` with the columns of their ``key`` in ``table``, which has one row for each key and in ``n`` how many rows share it. Give a stored table.

    Keys of at least 1 / ``heavy`` of all rows come by a broadcast, which has
    at most ``heavy`` rows.  The rest is shuffled, and rows that are served
    already are spread by ``spread``, so no task gets them all.
    """
    least = max(2, -(-(table.agg(F.sum(n)).first()[0] or 0) // heavy))
    names = [c for c in table.columns if c not in (key, n)]
    packed = table.select(F.col(key).alias("_key"), F.struct(*names).alias("_found"), (F.col(n) >= least).alias("_often"))
    often, rest = (packed.where(F.col("_often") == o).drop("_often") for o in (True, False))
    served = rows.join(F.broadcast(often.withColumnRenamed("_found", "_first")), F.col(key) == F.col("_key"), "left").drop("_key")
    served = served.withColumn("_salt", F.when(F.col("_first").isNotNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30))).otherwise(F.lit(0)))
    found = served.join(rest.withColumn("_zero", F.lit(0).cast("long")), (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    found = found.withColumn("_found", F.coalesce("_first", "_found")).where("_found is not null")
    return found.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in names])


def matched(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``table`` where columns ``on`` are equal or both null. Spark broadcasts a small table and splits hot keys otherwise."""
    other = table.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(other, same, how).drop(*[f"_of_{c}" for c in on])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which all executors share; in local mode a temporary folder will do where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster") and not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tessella-scratch-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt_out(rows: DataFrame) -> DataFrame:
    """``rows`` for work that is costly for each row: dealt to all cores where there are fewer partitions than cores, as with a small file of one row group; larger inputs stay as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
