"""The generation loop asks models no more than needed; revalidation and cached verdicts."""

import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import generation


def test_models_are_asked_for_open_seeds_only(spark):
    asked = spark.sparkContext.accumulator(0)
    judged = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def model(seed: pd.Series, attempt: pd.Series) -> pd.Series:
        asked.add(len(seed))
        return seed.astype(str) + "/" + attempt.astype(str)

    @F.pandas_udf("boolean")
    def judge(target: pd.Series) -> pd.Series:
        judged.add(int(target.notna().sum()))
        seed = target.str.split("/").str[0].astype(int)
        return (seed % 10 == 3) & target.str.endswith("/1")

    seeds = spark.range(100).withColumnRenamed("id", "seed")
    create = lambda n: {"target": model(F.col("seed"), F.lit(n)), "retain": F.lit("r")}
    check = lambda target, retain: F.when(target.rlike("^[0-9]*7/[12]$"), "ends in 7")
    rows = {r["seed"]: r for r in generation.attempts(seeds, create, check, lambda t, r: judge(t)).collect()}
    assert len(rows) == 100 and asked.value == 100 + 20 + 10  # all; those that end in 3 and 7; those in 7
    assert judged.value == 90 + 10 + 10  # those that pass the check
    assert {rows[k]["attempt"] for k in range(3, 100, 10)} == {2} and {rows[k]["attempt"] for k in range(7, 100, 10)} == {3}
    assert {r["outcome"] for r in rows.values()} == {"accepted"}
    none = generation.attempts(seeds, create, lambda t, r: F.lit("never"), most=2)
    assert {(r["attempt"], r["outcome"]) for r in none.collect()} == {(2, "never")}


def test_other_polarity(spark):
    seeds = spark.createDataFrame([(1, True), (2, False), (3, None)], "seed int, said boolean")
    create = lambda n: {"target": F.col("said").cast("string"), "retain": F.lit("")}
    judge = lambda t, r: t == "true"
    never = lambda t, r: F.lit(None).cast("string")
    outcome = lambda accept: {r["seed"]: r["outcome"] for r in generation.attempts(seeds, create, never, judge, most=1, accept_if=accept).collect()}
    assert outcome(False) == {1: "rejected", 2: "accepted", 3: "accepted"}
    assert outcome(True) == {1: "accepted", 2: "rejected", 3: "accepted"}


def test_errors_are_no_votes_against_a_pair(spark):
    votes = [("a", "x", True, False), ("a", "y", None, True), ("a", "z", None, True)]  # one of three: stays
    votes += [("b", "x", True, False), ("b", "y", True, False), ("b", "z", None, True)]  # two of three: goes
    votes += [("c", "x", None, True), ("c", "y", None, True), ("c", "z", None, True)]
    rows = spark.createDataFrame([(*v, f"{v[1]} says so") for v in votes], "id string, judge string, vote boolean, error boolean, reason string")
    pairs = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    found = {r["id"]: (r["flagged"], r["_revalidation_reason"]) for r in generation.revalidated(pairs, rows, "id").collect()}
    assert found == {"a": (False, None), "b": (True, "x says so; y says so"), "c": (False, None), "d": (False, None)}
    assert [r["id"] for r in generation.revalidated(pairs, rows, "id", n_judges=5).where("flagged").collect()] == []


def test_cache_holds_for_its_answer_only(spark):
    answers = spark.createDataFrame([(1, "x"), (2, "new"), (3, None), (4, "y")], "id int, answer string")
    cache = spark.createDataFrame([(1, "x", "no"), (1, "x", "yes"), (2, "old", "no"), (3, None, "no")], "id int, answer string, verdict string")
    cache = cache.select("id", generation.answer_hash(F.col("answer")).alias("answer_hash"), "verdict")
    judge = lambda rows: rows.withColumn("verdict", F.lit("judged"))
    found = sorted((r["id"], r["verdict"]) for r in generation.cached_verdicts(answers, cache, ["id"], judge).collect())
    assert found == [(1, "no"), (2, "judged"), (3, "no"), (4, "judged")]
