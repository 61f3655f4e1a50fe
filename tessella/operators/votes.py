"""Judge votes in long form (item, judge, vote, error): panels, consensus, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio

EVIDENCE_PER_JUDGE, EVIDENCE_KEPT = 5, 10


def yes(vote: str = "vote", error: str | None = "error") -> Column:
    found = F.coalesce(F.col(vote), F.lit(False))
    return found & ~F.coalesce(F.col(error), F.lit(False)) if error else found


def majority(n: Column) -> Column:
    return F.expr("1") + F.floor(n / 2)


def panel(votes: DataFrame, by: list[str], vote: str = "vote", error: str | None = "error", n_judges: int | None = None) -> DataFrame:
    """Strict majority of the configured judges; an error is no vote for it.

    n_flagged, flagged, agreement (all_clean, one_dissent: less than a majority,
    majority_reject) and whether the panel was borderline.
    """
    n = F.lit(n_judges) if n_judges else F.count("*")
    found = votes.groupBy(*by).agg(n.cast("long").alias("n_judges"), F.count_if(yes(vote, error)).alias("n_flagged"))
    needed = majority(F.col("n_judges"))
    return found.withColumns(
        {
            "flagged": F.col("n_flagged") >= needed,
            "agreement": F.when(F.col("n_flagged") == 0, "all_clean").when(F.col("n_flagged") < needed, "one_dissent").otherwise("majority_reject"),
            "borderline": F.col("n_flagged") == needed,
        }
    )


def null_strict(votes: DataFrame, by: list[str], vote: str = "vote") -> DataFrame:
    """Majority, but null as soon as one vote is missing."""
    found = votes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(vote).isNull()).alias("missing"), F.count_if(F.col(vote)).alias("trues"))
    return found.select(*by, F.when(F.col("missing") == 0, F.col("trues") >= majority(F.col("n"))).alias("verdict"))


def unanimous(votes: DataFrame, by: list[str], vote: str = "vote") -> DataFrame:
    found = votes.groupBy(*by).agg(F.count_if(F.col(vote).isNull()).alias("missing"), F.bool_and(vote).alias("every"))
    return found.select(*by, F.when(F.col("missing") == 0, F.col("every")).alias("verdict"))


def evidence(votes: DataFrame, by: list[str], judge_order: str, vote: str = "vote", evidence: str = "evidence") -> DataFrame:
    """The first five pieces of every judge that votes yes, in judge order, ten in all."""
    own = F.struct(F.col(judge_order).alias("o"), F.slice(F.col(evidence), 1, EVIDENCE_PER_JUDGE).alias("e"))
    found = votes.where(yes(vote, None)).groupBy(*by).agg(F.array_sort(F.collect_list(own)).alias("all"))
    return found.select(*by, F.slice(F.flatten(F.transform("all", lambda x: x["e"])), 1, EVIDENCE_KEPT).alias("evidence"))


def dissent(votes: DataFrame, verdicts: DataFrame, by: list[str], judge: str = "judge") -> DataFrame:
    """(judge, dissents): how often a judge stood against the panel; errors do not."""
    joined = votes.join(verdicts.select(*by, "flagged"), by)
    against = F.when(F.col("flagged"), ~yes() & ~F.coalesce(F.col("error"), F.lit(False))).otherwise(yes())
    return joined.groupBy(judge).agg(F.count_if(against).alias("dissents"), F.count_if(yes()).alias("flags"), F.count("*").alias("n")).withColumn("flag_rate", F.round(ratio(F.col("flags"), F.col("n"), 0), 4))


def consensus(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals per agreement, passed, borderline and the rejection rate (four decimals), in all or per group."""
    kinds = [F.count_if(F.col("agreement") == k).alias(k) for k in ("all_clean", "one_dissent", "majority_reject")]
    return verdicts.groupBy(*(by or [])).agg(F.count("*").alias("total"), *kinds, F.count_if(~F.col("flagged")).alias("passed"), F.count_if("borderline").alias("borderline")).withColumn(
        "rejection_rate", F.round(ratio(F.col("total") - F.col("passed"), F.col("total"), 0), 4)
    )


def from_reasons(log: DataFrame, reason: str = "reason") -> DataFrame:
    """Table of buckets from a text log 'judge=TRUE; ...': entries with ERROR count in the total only."""
    trues = F.regexp_count(F.col(reason), F.lit("=TRUE"))
    ok = ~F.contains(F.col(reason), F.lit("ERROR"))
    return log.agg(
        F.count("*").alias("total"), F.count_if(ok & (trues == 0)).alias("all_clean"), F.count_if(ok & (trues == 1)).alias("one_dissent"), F.count_if(ok & (trues >= 2)).alias("majority_reject")
    )


def rejection_by(verdicts: DataFrame, category: str, k: int | None = None) -> DataFrame:
    """Rejection rate per category, highest first; the first ``k`` where asked for."""
    found = verdicts.groupBy(category).agg(F.count("*").alias("n"), F.count_if("flagged").alias("rejected")).withColumn("rate", F.round(ratio(F.col("rejected"), F.col("n"), 0), 4))
    ordered = found.orderBy(F.col("rate").desc(), category)
    return ordered.limit(k) if k else ordered


def calibration(verdicts: DataFrame, by: list[str], side: str = "side", verdict: str = "verdict") -> DataFrame:
    """Mean verdict of each side over its own valid verdicts, their difference in points (one decimal), and the action."""
    mean = lambda s: F.avg(F.when(F.col(side) == s, F.col(verdict).cast("int")))
    found = verdicts.groupBy(*by).agg(mean("target").alias("target_rate"), mean("retain").alias("retain_rate"))
    points = F.round(100.0 * (F.col("target_rate") - F.col("retain_rate")), 1)
    return found.withColumn("delta_pp", points).withColumn("action", F.when(F.abs("delta_pp") < 5, "none").otherwise(F.concat(F.lit("subtract "), F.format_string("%+.1f", F.col("delta_pp")), F.lit(" pp"))))
