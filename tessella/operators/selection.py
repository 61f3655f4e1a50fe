"""Choosing and looking up: models by what they need and cover, worked examples, judges by question, merged result trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..joins import matched
from ..sources.sinks import Versioned


def models(table: DataFrame, names: list[str] | None = None, hardware: str | None = None, most_params: float = 0) -> DataFrame:
    """Rows of (model, size_b, hardware, ...) of an explicit list, or else of a kind of hardware, and of at most so many billion parameters (0: any). A name that the table lacks is an error."""
    found = table
    if names:
        unknown = sorted(set(names) - {r["model"] for r in table.where(F.col("model").isin(names)).select("model").distinct().collect()})  # of a list that was typed
        if unknown:
            raise ValueError(f"no model is named {', '.join(unknown)}")
        found = found.where(F.col("model").isin(names))
    elif hardware:
        found = found.where(F.col("hardware") == hardware)
    return found.where(F.col("size_b") <= most_params) if most_params > 0 else found


def representatives(wide: DataFrame, key: str, scores: list[str], average: str, preferred: list[str], least: int = 4, first: int = 6) -> DataFrame:
    """(key): the preferred ones that are there, if at least ``least`` are; else the ``first`` by how many scores they have, then by their average."""
    have = wide.where(F.col(key).isin(preferred)).select(key).distinct()
    if have.count() >= least:
        return have
    covered = sum((F.col(s).isNotNull().cast("int") for s in scores), F.lit(0))
    return wide.withColumn("_covered", covered).orderBy(F.desc("_covered"), F.desc_nulls_last(average), key).limit(first).select(key)


def positions(rows: DataFrame, by: list[str], score: str, key: str, name: str = "position") -> DataFrame:
    """``rows`` of a report with their place from 0 on, in order of score, then key, in each group of ``by``. Places of a group are given in one task."""
    from pyspark.sql import Window

    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(score, key)) - 1)


def same_pair(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether {a, b} and {c, d} are the same pair, in whatever order."""
    return F.coalesce(((a == c) & (b == d)) | ((a == d) & (b == c)), F.lit(False))


def mapped(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of their key in ``table``; those without any, or with a null, go."""
    names = [c for c in table.columns if c != on]
    return rows.join(table.dropna(subset=names), on)


def with_examples(seeds: DataFrame, examples: DataFrame, by: list[str], order: str, names: list[str]) -> DataFrame:
    """``seeds`` with ``examples``: the worked examples of their cell in order, an empty array where there are none."""
    of_cell = examples.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *names))), lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("examples"))
    found = matched(seeds, of_cell, by, "left")
    kind = dict(of_cell.dtypes)["examples"]
    return found.withColumn("examples", F.coalesce("examples", F.array().cast(kind)))


def examples_block(examples: Column, show: Callable[[Column, Column], Column], head: str, tail: str) -> Column:
    """The examples as text, numbered from 1, between ``head`` and ``tail``; empty without any."""
    shown = F.array_join(F.transform(examples, lambda x, k: show(x, k + 1)), "\n\n")
    return F.when(F.size(examples) > 0, F.concat(F.lit(head), shown, F.lit(tail))).otherwise(F.lit(""))


def by_question(answers: DataFrame, question: str, judges: list[str], parts: int | None = None) -> DataFrame:
    """``answers`` once for each judge, in column ``judge``, dealt so that a task has the answers to one question of one judge together; a question that many answers share is dealt over several tasks."""
    each = answers.withColumn("judge", F.explode(F.array(*map(F.lit, judges))))
    columns = [F.col("judge"), F.col(question)]
    ordered = each.repartitionByRange(parts, *columns, F.rand(1)) if parts else each.repartitionByRange(*columns, F.rand(1))
    return ordered.sortWithinPartitions(*columns)


def quick_accuracy(graded: DataFrame, by: list[str], target: str = "target", retain: str = "retain", target_ok: str = "target_ok", retain_ok: str = "retain_ok") -> DataFrame:
    """(by, n, target_acc, retain_acc, CA), to four places: over the pairs that have both texts; a verdict that is missing counts as wrong."""
    pairs = graded.where((F.col(target) != "") & (F.col(retain) != ""))
    hits = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    found = pairs.groupBy(*by).agg(F.count("*").alias("n"), hits(target_ok).alias("t"), hits(retain_ok).alias("r"))
    t, r = ratio(F.col("t"), F.col("n"), 0), ratio(F.col("r"), F.col("n"), 0)
    return found.select(*by, "n", F.round(t, 4).alias("target_acc"), F.round(r, 4).alias("retain_acc"), F.round(t - r, 4).alias("CA"))


def model_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(model, corpus, result, at) of the JSON files of a folder: one row for each corpus of each file's ``results``, the result as JSON text and its timestamp. Tables and per-category files (by name), files that cannot be read and such that are no object are passed over; a file without a model's name goes by its own."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(name.alias("file"), "value")
    files = files.where(~F.col("file").startswith("percategory_") & ~F.col("file").startswith("table"))
    parsed = F.from_json("value", "model string, results map<string,string>, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = files.select("file", parsed.alias("p")).where("p is not null and p._corrupt_record is null")
    rows = read.select(F.coalesce(F.nullif("p.model", F.lit("")), F.col("file")).alias("model"), F.explode("p.results").alias("corpus", "result"))
    return rows.withColumn("at", F.get_json_object("result", "$.timestamp"))


def merge_tree(spark: SparkSession, folder: str, table: Versioned) -> DataFrame:
    """Merge the documents of a folder into the table of (model, corpus, result, at), the newer result of each key winning, none being lost; (model, corpora) of the models that the folder has, as merged."""
    new = model_documents(spark, folder)
    merged = table.upsert(new, ["model", "corpus"], "at")
    seen = new.select("model").distinct()
    return merged.join(seen, "model", "left_semi").groupBy("model").agg(F.array_sort(F.collect_list("corpus")).alias("corpora"))
