"""Writers: JSON lines, appends with resume, routed and versioned tables, reports."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import carry_forward, remaining, upsert


def json_overwrite(rows: DataFrame, path: str) -> None:
    """JSON lines; characters beyond ASCII stay as they are, null fields are left out."""
    rows.write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, keys: list[str], spark: SparkSession) -> int:
    """Append the rows whose key is not in the table yet; returns how many. A second run with the same rows adds none."""
    try:
        rows = remaining(rows, spark.read.parquet(path), keys)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def routed(rows: DataFrame, path: str, holdout: Column) -> None:
    """Rows go to the partition split=holdout or split=train."""
    rows.withColumn("split", F.when(holdout, "holdout").otherwise("train")).write.mode("append").partitionBy("split").parquet(path)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole and only where there is none yet; false where there is one. It is written aside and then linked (local files) or renamed (Hadoop stores), which one of several writers can do."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = hadoop.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(target) and fs.rename(aside, target)
        os.link(aside.toUri().getPath(), target.toUri().getPath())  # a local rename would replace the file
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(aside, False)


class Versioned:
    """A table of versions in folders, and a pointer for each version in number order.

    A version is written aside and then named by its pointer, so readers never
    see half of it, and it may be computed from the one before.  A pointer is
    published by a rename that fails where its number is taken: of two writers
    with one base only the first gets the number, the other merges again with
    what the first has written, so neither loses rows of the other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> tuple[int, str | None]:
        """The number and the folder of the newest version; (-1, None) without any."""
        try:
            rows = self.spark.read.schema("version long, folder string").json(f"{self.path}/_pointers")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return -1, None
        best = rows.orderBy(F.col("version").desc()).first()
        return (best["version"], best["folder"]) if best else (-1, None)

    def current(self) -> str | None:
        return self.latest()[1]

    def read(self) -> DataFrame | None:
        folder = self.current()
        return self.spark.read.parquet(folder) if folder else None

    def publish(self, number: int, folder: str) -> bool:
        """Name ``folder`` version ``number``; false where that number is taken."""
        return put_once(self.spark, f"{self.path}/_pointers/version-{number:012d}.json", json.dumps({"version": number, "folder": folder}) + "\n")

    def change(self, make: Callable[[DataFrame | None], DataFrame | None], tries: int = 20) -> DataFrame | None:
        """A new version made from the current one, made again from the newer one where another writer came first. Without a result no version is written."""
        for _ in range(tries):
            number, before = self.latest()
            rows = make(self.spark.read.parquet(before) if before else None)
            if rows is None:
                return None
            folder = f"{self.path}/data-{uuid.uuid4().hex}"
            rows.write.parquet(folder)
            if self.publish(number + 1, folder):
                return self.spark.read.parquet(folder)
        raise RuntimeError(f"{self.path}: {tries} times another writer came first")

    def write(self, rows: DataFrame) -> str:
        """``rows`` as the new version, whatever was there."""
        self.change(lambda old: rows)
        return self.current()

    def upsert(self, new: DataFrame, keys: list[str], timestamp: str) -> DataFrame:
        """Merge by key (see ``operators.upsert``) into a new version."""
        return self.change(lambda old: new if old is None else upsert(old, new, keys, timestamp))

    def rewrite(self, change, key: str, dry_run: bool = False) -> dict:
        """Replace every row by ``change``; the count of rows and their keys must not move. Without a change no version is written."""
        found: dict = {}

        def make(old: DataFrame) -> DataFrame | None:
            new = change(old)
            n_old, n_new = old.count(), new.count()
            lost = old.select(key).exceptAll(new.select(key)).count()
            changed = new.exceptAll(old).count()
            if n_old != n_new or lost:
                raise ValueError(f"the change would turn {n_old} rows into {n_new} and lose {lost} keys")
            found.update(rows=n_old, changed=changed, written=bool(changed) and not dry_run)
            return new if found["written"] else None

        self.change(make)
        return found


def filtered_copy(rows: DataFrame, drop: DataFrame, key: str, path: str) -> tuple[int, int]:
    """Write the rows whose key is not in ``drop``; (kept, dropped)."""
    marked = rows.join(drop.select(F.col(key), F.lit(True).alias("_drop")).distinct(), key, "left")
    from pyspark.sql import Observation

    seen = Observation()
    kept = marked.observe(seen, F.count_if(F.col("_drop").isNull()).alias("kept"), F.count_if(F.col("_drop").isNotNull()).alias("dropped")).where("_drop is null").drop("_drop")
    kept.write.mode("overwrite").parquet(path)
    return seen.get["kept"], seen.get["dropped"]


def merge_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Reports by key: new ones replace, others stay."""
    return carry_forward(old, new, key)


def partitions_overwrite(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that the rows belong to."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


EVAL_RESULT = "model string, task string, accuracy double, n_samples long, seed long, experiment string, driver_path string"


def append_results(rows: DataFrame, path: str) -> None:
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(EVAL_RESULT)
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(path)


def table_text(rows: DataFrame, kind: str = "markdown", decimals: int = 3, most: int = 1000) -> str:
    """A report of a small table as Markdown, LaTeX or JSON; longer ones than ``most`` rows are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    show = lambda v: "" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    cells = [[show(v) for v in r] for r in found]
    if kind == "json":
        return json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, default=str)
    if kind == "latex":
        body = [" & ".join(r) + r" \\" for r in [list(rows.columns), *cells]]
        return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}"])
    return "\n".join("| " + " | ".join(x.replace("|", r"\|") for x in r) + " |" for r in [list(rows.columns), ["---"] * len(rows.columns), *cells])
