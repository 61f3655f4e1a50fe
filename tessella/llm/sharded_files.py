"""What the writers of archives and of token files share: shards by id, temporary names, manifests.

Shard bounds are quantiles (by bytes) of a sample that a hash of the id picks:
equal input gives equal shards on any cluster.  Tasks write files under
temporary names and report them as rows.  The rows are stored, the files are
moved to their final names, and last the manifest appears under its own name;
readers follow it, so files of lost or repeated attempts never count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_BYTES, LEAST_SHARDS = 64 << 20, 16
SAMPLE_ROWS = 20_000
#: Bytes that any row counts besides its content.
ROW_BYTES = 512
STAGED = "shard int, seq int, temporary string, name string, n_records long, n_bytes long, sha256 string"
MANIFEST = STAGED.replace("temporary string, ", "")
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path, on the driver and in tasks alike."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def bounds(ids: DataFrame, key: str) -> np.ndarray:
    """Lower bounds of all shards but the first, over (key, n_bytes).

    The sample is sorted and summed up by Spark; the driver gets one number a
    shard, eight bytes for SHARD_BYTES of data.
    """
    weight = F.col("n_bytes") + ROW_BYTES
    total = ids.agg(F.count(key).alias("n"), F.sum(weight).alias("b")).first()
    if not total["n"]:
        return np.empty(0, dtype=np.int64)
    shards = max(LEAST_SHARDS, -(-total["b"] // SHARD_BYTES))
    every = max(1, total["n"] // max(SAMPLE_ROWS, 20 * shards))
    sample = ids.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0))
    rows = sample.groupBy(F.col(key).alias("at")).agg(F.sum(weight).alias("b")).repartitionByRange("at").sortWithinPartitions("at")
    rows = cut(rows.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    parts = rows.groupBy("part").agg(F.sum("b").alias("b"))  # a row a partition
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("b").over(ranges), F.lit(0)).alias("before"), F.sum("b").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("b").over(inside), F.lit(0)) + F.col("before")
    placed = rows.join(F.broadcast(before), "part").select("at", F.floor(above.cast("decimal(38,0)") * shards / F.col("all")).alias("shard"))
    cuts = placed.where("shard > 0").groupBy("shard").agg(F.min("at").alias("at"))
    return np.sort(cuts.select("at").toArrow().column("at").to_numpy())


def shard_of(key: Column, cuts: Broadcast) -> Column:
    """The number of cuts at or below the key, searched in the broadcast bounds; 0 for null."""

    @F.arrow_udf("int")
    def search(keys: pa.Array) -> pa.Array:
        found = np.searchsorted(cuts.value, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(np.asarray(keys.is_null()), 0, found).astype(np.int32))

    return search(key)


def dealt(rows: DataFrame, key: str, cuts: np.ndarray, *order: str) -> DataFrame:
    """``rows`` with ``shard``, a shard wholly in one partition and alone in it, sorted by (shard, key, order)."""
    given = rows.sparkSession.sparkContext.broadcast(np.asarray(cuts, dtype=np.int64))
    dealt = rows.withColumn("shard", shard_of(F.col(key), given)).repartitionById(len(cuts) + 1, F.col("shard"))
    return dealt.sortWithinPartitions("shard", key, *order)


class Output:
    """An open file of a shard under its temporary name."""

    def __init__(self, uri: str, shard: int, seq: int, ending: str):
        fs, root = store(uri)
        self.shard, self.seq, self.size, self.sum, self.n_records = shard, seq, 0, hashlib.sha256(), 0
        self.name = f"part-{shard:06d}-{seq:04d}.{ending}"
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/_temporary", recursive=True)
        self.out = fs.open_output_stream(f"{root}/{self.temporary}", compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.seq, self.temporary, self.name, self.n_records, self.size, self.sum.hexdigest()


def staged(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in STAGED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], KINDS[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def publish(reports: DataFrame, uri: str) -> DataFrame:
    """Run the writing tasks whose rows are ``reports``, commit their files, and return the manifest."""
    spark: SparkSession = reports.sparkSession

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(uri)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/{row['temporary']}", f"{root}/{row['name']}"
                if fs.get_file_info(source).type != pafs.FileType.NotFound:
                    fs.move(source, target)
                if fs.get_file_info(target).size != row["n_bytes"]:
                    raise OSError(f"{row['name']}: its size is not that of the manifest")
            yield batch

    fs, root = store(uri)
    reports.write.mode("overwrite").parquet(f"{uri}/_staged")
    found = spark.read.schema(STAGED).parquet(f"{uri}/_staged")
    found.mapInArrow(move, STAGED).drop("temporary").write.mode("overwrite").parquet(f"{uri}/_publishing")
    fs.move(f"{root}/_publishing", f"{root}/manifest")
    for left in ("_staged", "_temporary"):
        if fs.get_file_info(f"{root}/{left}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{left}")
    return manifest(spark, uri)


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def by_file(files: DataFrame) -> DataFrame:
    """Manifest rows dealt out so that few files share a task."""
    return files.repartition(max(1, 4 * files.sparkSession.sparkContext.defaultParallelism), "name")
