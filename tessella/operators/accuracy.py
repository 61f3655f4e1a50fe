"""Contrastive accuracy: graded pairs to accuracies per model, corpus and cell, pivots, bias correction, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio

# Judge bias by primitive, and what primitive a corpus measures.
BIAS = {"ToM": 0.14, "Causal": 0.16, "Moral": 0.0, "Strategic": 0.22, "Spatial": 0.0, "Null": 0.70}
PRIMITIVES = {"spl_cc": "Math", "tom_cc": "ToM", "ctr_cc": "Causal", "mor_cc": "Moral", "str_cc": "Strategic", "stp_cc": "Spatial", "core_math": "Proof", "null_cc": "Null", "coin": "COIN"}
EXCLUDED = ("Math", "Proof")
TIERS = ("1.7-3.8B", "7-9B", "12-14B", "27-72B")


def category_of(category: Column, seed_topic: Column | None = None) -> Column:
    return F.coalesce(category, *([seed_topic] if seed_topic is not None else []), F.lit("unknown"))


def contrastive(graded: DataFrame, by: list[str], cells: list[str], target: str = "target_ok", retain: str = "retain_ok") -> DataFrame:
    """Accuracy of both sides over one denominator, their difference, per group and per cell of it, in one pass.

    Pairs with a null verdict on either side are skipped and counted.
    ``level`` is 'all' or 'cell'; an empty group has accuracies of 0.
    """
    valid = F.col(target).isNotNull() & F.col(retain).isNotNull()
    counts = [
        F.count_if(valid).alias("total_pairs"), F.count_if(~valid).alias("skipped"),
        F.count_if(valid & F.col(target)).alias("n_target"), F.count_if(valid & F.col(retain)).alias("n_retain"),
    ]
    if cells:
        keys = [F.col(c) for c in [*by, *cells]]
        whole = F.grouping_id() > 0
        found = graded.groupingSets([keys, keys[: len(by)]], *keys).agg(F.when(whole, "all").otherwise("cell").alias("level"), *counts)
    else:
        found = graded.groupBy(*by).agg(F.lit("all").alias("level"), *counts)
    t, r = ratio(F.col("n_target"), F.col("total_pairs"), 0), ratio(F.col("n_retain"), F.col("total_pairs"), 0)
    return found.withColumns({"acc_target": t, "acc_retain": r, "contrastive_accuracy": t - r}).drop("n_target", "n_retain")


def pivot(long: DataFrame, by: list[str], primitive: str, values: list[str], primitives: list[str]) -> DataFrame:
    """One column for each primitive and value; of repeated rows the greatest value stays."""
    return long.groupBy(*by).pivot(primitive, primitives).agg(*[F.max(v).alias(v) for v in values])


def unpivot(wide: DataFrame, ids: list[str], columns: list[str], suffix: str = "_CA", name: str = "primitive", value: str = "ca") -> DataFrame:
    """Wide scores to (ids, primitive, ca); missing ones go."""
    return wide.unpivot(ids, columns, name, value).withColumn(name, F.regexp_replace(name, f"{suffix}$", "")).where(F.col(value).isNotNull())


def log_params(size_b: Column) -> Column:
    return F.log10(size_b * 1e9)


def bias_corrected(long: DataFrame, bias: dict[str, float] | None = None, primitive: str = "primitive", ca: str = "ca") -> DataFrame:
    """Adds delta and ca_corrected; primitives without a known bias go."""
    bias = BIAS if bias is None else bias
    table = F.create_map(*[x for k, v in sorted(bias.items()) for x in (F.lit(k), F.lit(v))])
    return long.withColumn("delta", F.try_element_at(table, F.col(primitive))).where("delta is not null").withColumn("ca_corrected", F.col(ca) - F.col("delta"))


def profile(long: DataFrame, model: str = "model", ca: str = "ca") -> DataFrame:
    """The mean of the scores that a model has, and how many."""
    return long.groupBy(model).agg(F.avg(ca).alias("profile"), F.count(ca).alias("coverage"))


def tier_means(long: DataFrame, models: DataFrame, group: str, primitives: list[str], ca: str = "ca") -> DataFrame:
    """Mean per group and primitive over all models; a missing score counts as 0."""
    names = models.sparkSession.createDataFrame([(p,) for p in primitives], "primitive string")
    full = models.select("model", group).crossJoin(F.broadcast(names)).join(long.select("model", "primitive", ca), ["model", "primitive"], "left")
    return full.groupBy(group, "primitive").agg(F.avg(F.coalesce(F.col(ca), F.lit(0.0))).alias("mean_ca"))


def correlation(wide: DataFrame, a: str, b: str, missing: str = "pairwise") -> Column:
    """Pearson; ``missing``: 'zero' counts missing as 0, 'pairwise' uses rows that have both."""
    x, y = (F.coalesce(F.col(c), F.lit(0.0)) for c in (a, b)) if missing == "zero" else (F.col(a), F.col(b))
    return F.corr(x, y)


def quadrant(ca: Column, acc_target: Column) -> Column:
    """Where a model stands: discrimination at 0.10, competence at 0.50."""
    return F.when((ca >= 0.10) & (acc_target >= 0.50), "discriminating").when(ca >= 0.10, "selective").when(acc_target >= 0.50, "indiscriminate").otherwise("weak")


def counts_per_primitive(long: DataFrame) -> DataFrame:
    """Observations, models, families, and families with two or more sizes."""
    per_family = long.groupBy("primitive", "family").agg(F.count("*").alias("n"), F.collect_set("model").alias("models"), F.count_distinct("size_b").alias("sizes"))
    return per_family.groupBy("primitive").agg(
        F.sum("n").alias("n_obs"), F.size(F.array_distinct(F.flatten(F.collect_list("models")))).alias("n_models"), F.count("*").alias("n_families"), F.count_if(F.col("sizes") >= 2).alias("n_families_multi_scale")
    )


def deficits(wide: DataFrame, ids: list[str], columns: list[str], k: int = 2) -> DataFrame:
    """The ``k`` lowest scores of every row."""
    from pyspark.sql import Window

    long = unpivot(wide, ids, columns)
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(*ids).orderBy("ca", "primitive"))).where(F.col("rank") <= k)
