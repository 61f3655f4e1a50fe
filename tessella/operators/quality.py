"""Quality flags, audits, exact duplicates, corpus statistics, CJK repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import exclusive_quantile, ratio
from ..joins import dealt_out, joined, scratch

SHORT = 200


def flags(pairs: DataFrame, target: str = "target", retain: str = "retain") -> DataFrame:
    """Adds q1_empty, q2_short, bad_quality and q_cjk: empty, short but not empty, either, and CJK characters on either side."""
    t, r = (F.coalesce(F.col(c), F.lit("")) for c in (target, retain))
    empty = (T.strip(t) == "") | (T.strip(r) == "")
    short = (F.length(T.strip(t)) < SHORT) | (F.length(T.strip(r)) < SHORT)
    return pairs.withColumns({"q1_empty": empty, "q2_short": ~empty & short, "bad_quality": short, "q_cjk": T.has_cjk(F.concat(t, r))})


def valid_pairs(pairs: DataFrame, target: str = "target", retain: str = "retain") -> DataFrame:
    """Both texts are there and not empty; blanks count as text."""
    return pairs.where((F.col(target) != "") & (F.col(retain) != ""))


def duplicates(rows: DataFrame, text: str = "target", key: str = "id", form: str = "normal", digits: int = 16, decompose: bool = True) -> DataFrame:
    """Adds ``hash``, ``is_duplicate`` and ``first_key``: the first row in order of ``key`` stays, later ones with an equal normal form are duplicates.

    The least key of a hash is found by an aggregate that combines before its
    shuffle; those of the most frequent hashes are broadcast (``joined``), so a
    text that a third of the rows share is no hot partition; rows that repeat a key are told apart by a row number.
    """
    normal = T.normal_form if form == "normal" else T.dedup_form
    hashed = dealt_out(rows).withColumn("hash", T.digest(normal(F.coalesce(F.col(text), F.lit("")), decompose), digits))
    first = hashed.groupBy("hash").agg(F.min(key).alias("first_key"), F.count("*").alias("_n"))
    path = scratch(rows.sparkSession, "first-keys")
    first.write.parquet(path)  # texts are hashed once for it and once in the join
    return joined(hashed, rows.sparkSession.read.parquet(path), "hash", "_n", key).select(*rows.columns, "hash", "first_key").withColumn("is_duplicate", F.col(key) > F.col("first_key"))


def quality_filter(rows: DataFrame, target: str = "target", retain: str = "retain", key: str = "id", decompose: bool = True) -> DataFrame:
    """Rows with CJK characters go first, so they claim no hash; then duplicates of the target go."""
    clean = rows.where(~T.has_cjk(F.concat(F.coalesce(F.col(target), F.lit("")), F.coalesce(F.col(retain), F.lit("")))))
    return duplicates(clean, target, key, form="dedup", digits=64, decompose=decompose).where(~F.col("is_duplicate")).select(*rows.columns)


def audit(flagged: DataFrame, by: list[str], contaminated: str | None = None) -> DataFrame:
    """Counts of each flag, of rows with any flag, and the percentage of those; with both marginals nothing is scanned twice."""
    names = ["q1_empty", "q2_short", "is_duplicate", "q_cjk"] + ([contaminated] if contaminated else [])
    any_ = F.col(names[0])
    for name in names[1:]:
        any_ = any_ | F.col(name)
    counts = [F.count("*").alias("n_rows")] + [F.count_if(F.col(c)).alias(f"n_{c}") for c in names] + [F.count_if(any_).alias("total_flagged")]
    return flagged.groupBy(*by).agg(*counts).withColumn("drop_pct", F.round(100.0 * ratio(F.col("total_flagged"), F.col("n_rows"), 0), 2))


def percentiles(rows: DataFrame, by: list[str], value: Column, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """min, max, mean (one decimal) and linear percentiles of ``value`` per group."""
    found = rows.withColumn("_v", value).groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.round(F.avg("_v"), 1).alias("mean"), F.percentile("_v", list(at)).alias("_p"))
    return found.withColumns({f"p{round(100 * p)}": F.col("_p")[k] for k, p in enumerate(at)}).drop("_p")


def decile_summary(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """n, mean, median, exclusive p10 and p90 (least and largest below 10 values), min, max; whole numbers cut toward zero.

    Exact exclusive deciles need the ordered neighbours of two positions, which
    a distinct-value histogram gives: equal values are counted before the
    shuffle, so a group costs as many entries as it has different lengths.
    """
    melted = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.cast("double").alias("v")) for n, v in values.items()])).alias("m")).select(*by, "m.measure", "m.v").where("v is not null")
    keys = [*by, "measure"]
    counts = melted.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    running = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns({"upto": F.sum("c").over(running), "n": F.sum("c").over(whole)})

    def kth(k: Column) -> Column:
        return F.min(F.when(F.col("upto") >= k, F.col("v")))

    def quantile(i: int) -> Column:
        place = F.lit(i) * (F.col("n") + 1)
        j = F.least(F.greatest(F.expr(f"{i} * (n + 1) div 10"), F.lit(1)), F.col("n") - 1)
        return kth(j) * (10 - (F.max(place) - 10 * F.max(j))) + kth(j + 1) * (F.max(place) - 10 * F.max(j))

    half = (kth(F.expr("(n + 1) div 2")) + kth(F.expr("n div 2 + 1"))) / 2
    found = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 1).alias("mean"),
        half.cast("long").alias("median"),
        F.when(F.max("n") >= 10, quantile(1) / 10).otherwise(F.min("v")).cast("long").alias("p10"),
        F.when(F.max("n") >= 10, quantile(9) / 10).otherwise(F.max("v")).cast("long").alias("p90"),
        F.min("v").cast("long").alias("min"),
        F.max("v").cast("long").alias("max"),
    )
    return found


def deciles_of(values: Column) -> Column:
    """The exclusive deciles p10 and p90 of a short array, as whole numbers."""
    ordered = F.array_sort(values)
    small = F.size(ordered) < 10
    return F.struct(
        F.when(small, F.array_min(ordered)).otherwise(exclusive_quantile(ordered, 1)).cast("long").alias("p10"),
        F.when(small, F.array_max(ordered)).otherwise(exclusive_quantile(ordered, 9)).cast("long").alias("p90"),
    )


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by (a, b), a, b and in all, in one pass; ``grouping`` tells which."""
    return rows.cube(a, b).agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"), F.count_distinct(F.struct(a, b)).alias("n_strata"))


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values, ties in order of the value, and how many different ones there are."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    different = counts.agg(F.count("*").alias("n_different"))
    return counts.orderBy(F.col("n").desc(), F.col(column)).limit(k).crossJoin(F.broadcast(different))  # one row


def cjk_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Changes of each class over ``columns``; only rows whose text changes count."""
    out = rows
    for c in columns:
        out = out.withColumns({f"_new_{c}": T.repair_cjk(F.col(c)), f"_by_{c}": T.cjk_changes(F.col(c))})
    changed = [F.coalesce(F.col(f"_new_{c}") != F.col(c), F.lit(False)) for c in columns]
    classes = ("fullwidth_ascii", "explicit_punct", "other_cjk_punct", "ideograph", "multichar_leak")
    sums = [F.coalesce(F.sum(sum((F.when(x, F.col(f"_by_{c}")[k]).otherwise(0) for c, x in zip(columns, changed, strict=True)), F.lit(0))), F.lit(0)).alias(k) for k in classes]
    any_ = changed[0]
    for x in changed[1:]:
        any_ = any_ | x
    return out.agg(F.count("*").alias("rows"), F.count_if(any_).alias("changed_rows"), *sums)
