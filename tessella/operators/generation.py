"""Generating pairs: create, validate, judge, keep, and try again what failed.

Creators and judges are column functions, so a table, a deterministic rule or
a Pandas UDF around a model all fit.  Every attempt is one pass over the seeds
that have no accepted pair yet; no row is looped over by the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import scratch
from .votes import panel, yes

Create = Callable[[int], dict[str, Column]]  # attempt -> columns target and retain
Check = Callable[[Column, Column], Column]  # (target, retain) -> reason, null where the pair passes
Judge = Callable[[Column, Column], Column]  # (target, retain) -> true, false, or null for an error


def attempts(seeds: DataFrame, create: Create, check: Check, judge: Judge | None = None, most: int = 3, accept_if: bool = False) -> DataFrame:
    """Adds attempt, target, retain and outcome: of each seed the first pair that passes, else the last one tried.

    ``outcome`` is accepted, rejected (the judge) or the check's reason.  A
    judge flags leakage, so false accepts; with ``accept_if`` true its polarity
    is the other way round.  A judge that errs does not reject.

    Every attempt is written to the shared folder, its pairs before they are
    judged, and the next one reads the seeds that are still open there.  So a
    model behind ``create`` is asked for a row once an attempt, and not at all
    where the seed is done, and one behind ``judge`` only for pairs that pass
    the check, also when an executor is lost later.
    """
    spark, names = seeds.sparkSession, seeds.columns

    def written(rows: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    still_open, found = seeds, []
    for number in range(1, most + 1):
        pair = create(number)
        tried = written(still_open.select(*names, F.lit(number).alias("attempt"), pair["target"].alias("target"), pair["retain"].alias("retain")), "attempt")
        target, retain = F.col("target"), F.col("retain")
        checked = tried.withColumn("outcome", check(target, retain))
        passed = checked.where("outcome is null")
        flagged = F.coalesce(judge(target, retain), F.lit(accept_if)) if judge else F.lit(accept_if)
        outcome = F.when(flagged == F.lit(accept_if), "accepted").otherwise("rejected")
        judged = written(passed.withColumn("outcome", outcome).unionByName(checked.where("outcome is not null")), "judged")
        failed = judged.where(F.col("outcome") != "accepted")
        last = number == most or failed.isEmpty()
        found.append(judged if last else judged.where(F.col("outcome") == "accepted"))
        if last:
            break
        still_open = failed.select(*names)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def statistics(tried: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: seeds, accepted ones, those accepted at the first attempt, rejected and failed ones, and the mean number of attempts."""
    return tried.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if((F.col("outcome") == "accepted") & (F.col("attempt") == 1)).alias("at_once"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected"), F.count_if(~F.col("outcome").isin("accepted", "rejected")).alias("failed"), F.avg("attempt").alias("mean_attempts"),
    )


def revalidated(pairs: DataFrame, votes: DataFrame, key: str, n_judges: int | None = None) -> DataFrame:
    """Adds ``flagged`` and ``_revalidation_reason`` to ``pairs``.

    ``votes`` are (key, judge, vote, error, reason).  A pair is flagged by a
    majority of the configured judges (those that voted, where ``n_judges`` is
    not given); an error is no vote against it, and a pair without votes is
    accepted.  The reason lists those of the judges that flag it, in order of
    their names; it is null where the pair is accepted.
    """
    verdicts = panel(votes, [key], n_judges=n_judges).select(key, "flagged")
    said = F.when(yes(), F.struct("judge", "reason"))
    reasons = votes.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["reason"]), "; ").alias("_reasons"))
    marked = pairs.join(verdicts.join(reasons, key), key, "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    return marked.withColumn("_revalidation_reason", F.when(F.col("flagged"), F.col("_reasons"))).drop("_reasons")


def cached_verdicts(answers: DataFrame, cache: DataFrame, key: list[str], judge: Callable[[DataFrame], DataFrame], text: str = "answer") -> DataFrame:
    """Verdicts of ``answers``: those in ``cache`` (key, answer_hash, verdict) are reused where the answer is still the one they were given for; only the others go to ``judge``. Of several verdicts for one answer the least counts."""
    names = [*answers.columns, "verdict"]
    hashed = answers.withColumn("answer_hash", answer_hash(F.col(text)))
    once = cache.groupBy(*key, "answer_hash").agg(F.min("verdict").alias("verdict"))
    known = hashed.join(once, [*key, "answer_hash"]).select(*names)
    return known.unionByName(judge(hashed.join(once, [*key, "answer_hash"], "left_anti").drop("answer_hash")).select(*names))


def answer_hash(text: Column) -> Column:
    """What ties a cached verdict to its answer; a null answer has one too."""
    return F.sha2(F.coalesce(F.concat(F.lit("="), text), F.lit("")), 256)
