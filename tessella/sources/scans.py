"""Readers: JSON lines, result trees, CSV matrices, files as rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .datasource import file_system
from .registry import COIN, CORPORA, PRIMARY, SPLITS, place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read the path, in whatever store it is."""
    try:
        spark.read.text(path).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


def json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, malformed: str = "skip") -> DataFrame:
    """Rows of JSON lines with a stated schema; blank lines are none, malformed ones are skipped, kept or raise."""
    mode = {"skip": "PERMISSIVE", "keep": "PERMISSIVE", "raise": "FAILFAST"}[malformed]
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if "_corrupt_record" not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    # read as text and parsed by an expression: the JSON reader refuses queries that need the malformed mark alone, such as counts
    parsed = F.from_json("value", schema, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(paths).where(strip(F.col("value")) != "").select(parsed.alias("r")).select("r.*")
    if malformed == "keep":
        return rows
    return (rows if malformed == "raise" else rows.where(F.col("_corrupt_record").isNull())).drop("_corrupt_record")


def corpus(spark: SparkSession, root: str, name: str, split: str, limit: int | None = None) -> DataFrame:
    """A corpus in its logical columns with its split; the limit stops the scan."""
    paths = [place(root, name, split)]
    if split == "bench" and not exists(spark, paths[0]):
        paths = [p for s in ("train", "holdout") if exists(spark, p := place(root, name, s))]
    own = CORPORA[name]
    rows = json_lines(spark, paths, own.schema()).select(*own.logical(), F.lit(split).alias("split"))
    return rows.limit(limit) if limit is not None else rows


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(corpus, split, n) of the files that are there, primary corpora first."""
    found = [(k, name, split, place(root, name, split)) for k, name in enumerate([*PRIMARY, *COIN]) for split in SPLITS]
    found = [x for x in found if exists(spark, x[3])]
    if not found:
        return spark.createDataFrame([], "corpus string, split string, n long")
    lines = spark.read.text([x[3] for x in found]).where(strip(F.col("value")) != "").select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"))
    names = F.broadcast(spark.createDataFrame([(k, name, split, path.rsplit("/", 1)[1]) for k, name, split, path in found], "o int, corpus string, split string, file string"))
    counts = lines.groupBy("file").agg(F.count("*").alias("n"))
    return names.join(counts, "file", "left").select("o", "corpus", "split", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("o", "split").drop("o")


def one_key(spark: SparkSession, path: str, key: str, most: int | None = None) -> DataFrame:
    """The values of one key; the limit counts lines, also those that lack it."""
    rows = json_lines(spark, path, T.StructType([T.StructField(key, T.StringType())]), "keep")
    rows = rows.limit(most) if most is not None else rows
    return rows.select(key).where(F.col(key).isNotNull())


def first_source(spark: SparkSession, *paths: str) -> str | None:
    """The first path that can be read."""
    return next((p for p in paths if exists(spark, p)), None)


def _struct(**fields: str) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in fields.items()) + ">"


RATES = {"acc_target": "double", "acc_retain": "double", "contrastive_accuracy": "double"}
CELL = _struct(category="string", difficulty="string", n="bigint", **RATES)
RESULT = _struct(corpus="string", primitive="string", status="string", total_pairs="bigint", empty_skipped="bigint", **RATES, per_category=f"map<string,{CELL}>", grading_method="string", timestamp="string")
MODEL_DOCUMENT = f"model string, size_b double, family string, arch string, tier string, hf_id string, hardware string, results map<string,{RESULT}>"


def result_tree(spark: SparkSession, path: str) -> DataFrame:
    """One row per model and corpus with an accuracy, from a folder of model documents; per-category files and unreadable ones are passed over."""
    docs = spark.read.schema(MODEL_DOCUMENT + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    docs = docs.where(~F.contains(F.col("_metadata.file_name"), F.lit("percategory"))).where("_corrupt_record is null and model is not null")
    rows = docs.select("model", "family", "size_b", "arch", "tier", F.explode("results").alias("_name", "r")).select("model", "family", "size_b", "arch", "tier", F.coalesce("r.corpus", "_name").alias("corpus"), "r.primitive", "r.status", "r.acc_target", "r.acc_retain", F.col("r.contrastive_accuracy").alias("ca"))
    return rows.where("status = 'ok' and ca is not null").drop("status").withColumn("log_params", F.log10(F.col("size_b") * 1e9))


def nested_metric(document: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds a number other than 0; NaN is none."""
    numbers = [F.get_json_object(document, p).try_cast("double") for p in paths]
    return F.coalesce(*[F.nullif(F.when(~F.isnan(x), x), F.lit(0.0)) for x in numbers])


def lm_eval_tree(spark: SparkSession, path: str) -> DataFrame:
    """(task, metric, value) of every ``results_*.json`` below ``path``; what is no number goes."""
    docs = spark.read.schema("results map<string,map<string,string>>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results_*.json").json(path)
    rows = docs.select(F.explode("results").alias("task", "m")).select("task", F.explode("m").alias("metric", "v"))
    return rows.where("metric <> 'alias'").select("task", F.regexp_replace("metric", ",none$", "").alias("metric"), F.col("v").try_cast("double").alias("value")).where("value is not null")


def aggregate_task(metrics: DataFrame, bench: str) -> DataFrame:
    """The task with the shortest name of every benchmark stands for all; the others are its subtasks."""
    return metrics.groupBy(bench).agg(F.min_by("task", F.struct(F.length("task"), "task")).alias("task"), F.count_distinct("task").alias("n_tasks"))


def first_metric(metrics: Column, names: tuple[str, ...] = ("acc_norm", "acc", "exact_match")) -> Column:
    """The first named metric of a map, -1 for none."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names], F.lit(-1.0))


def csv_matrix(spark: SparkSession, path: str, key: str, numbers: list[str] | None = None) -> DataFrame:
    """A CSV with header: lines that do not fit go, cells that are no number become null, the key is trimmed and lower-cased as ``join_key``."""
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    numbers = [c for c in rows.columns if c != key] if numbers is None else numbers
    parsed = {c: F.nullif(F.col(f"`{c}`").try_cast("double"), F.lit(float("nan"))) for c in numbers}
    return rows.withColumns(parsed).withColumn("join_key", F.lower(strip(F.col(key))))


CHUNK = 1 << 20


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of every file, empty ones too (which Spark's readers pass over); no content is read. Hidden files are left out as there."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while listed.hasNext():
        one = listed.next()
        if not one.getPath().getName().startswith(("_", ".")):
            found.append((one.getPath().toString(), one.getLen()))
    return spark.createDataFrame(found, "path string, bytes long")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256, md5) of every file: each is read in one task in pieces of a megabyte, so its size is not bounded by a row's. Of stores that Arrow cannot open Spark's reader gives the content, which holds for files of up to 2 GB."""
    files = files_below(spark, path)
    first = files.first()
    if first is None or openable(first["path"]):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [digests(p) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], ["path", "bytes", "sha256", "md5"])

        done = files.repartition(max(1, files.count())).mapInArrow(run, "path string, bytes long, sha256 string, md5 string")  # a file a task
    else:
        done = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    return done.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "bytes", "sha256", "md5")


def openable(path: str) -> bool:
    try:
        file_system(path)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def digests(path: str) -> tuple[str, str]:
    """SHA-256 and MD5 of one file, read piece by piece."""
    store, inner = file_system(path)
    sha256, md5 = hashlib.sha256(), hashlib.md5(usedforsecurity=False)
    with store.open_input_stream(inner) as stream:
        while piece := stream.read(CHUNK):
            sha256.update(piece)
            md5.update(piece)
    return sha256.hexdigest(), md5.hexdigest()


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.groupBy(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file")).agg(F.count("*").alias("lines"))


def metadata(spark: SparkSession, root: str, name: str = "corpus") -> dict:
    """A document that describes the files and record sets below ``root``: checksums, sizes and fields."""
    files = {r["file"]: r for r in checksums(spark, root).collect()}  # one row for each corpus file
    sets = []
    for c in CORPORA.values():
        for split in SPLITS:
            file = place(root, c.name, split).rsplit("/", 1)[1]
            if file in files:
                fields = [{"name": f, "dataType": "sc:DateTime" if f == "timestamp" else "sc:Text"} for f in c.schema().names if f != "_corrupt_record"]
                sets.append({"name": f"{c.name}_{split}", "key": "id", "source": file, "field": fields})
    distribution = [{"name": r["file"], "contentSize": r["bytes"], "sha256": r["sha256"], "md5": r["md5"]} for _, r in sorted(files.items())]
    return {"@type": "sc:Dataset", "name": name, "distribution": distribution, "recordSet": sets}
