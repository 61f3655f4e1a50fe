"""Benchmark runs, the generation loop, revalidation, and what sources and sinks write and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import order_key
from ..joins import scratch
from ..operators import generation, runner
from ..sources import scans, sinks
from .common import VOTES_SQL, digit, rounded, table
from .common import votes as vote_rows

LANGUAGES = ("de", "en", "es", "fr")


def hash_score(prompt: Column, choice: Column) -> Column:
    """A scorer that any engine can recompute."""
    return F.conv(F.substring(order_key(prompt, choice), 1, 6), 16, 10).cast("long")


def _run(limited: bool) -> runner.Run:
    choices = F.array(*[F.lit(x) for x in LANGUAGES])
    gold = F.nullif(F.array_position(choices, F.col("lang")), F.lit(0)).cast("int") - 1
    return runner.Run(
        "doc_id", "Text: {{text}}\nWhich of A to D is its language?", {"text": F.col("text")}, F.transform(choices, lambda c, k: F.concat(runner.letter(k), F.lit(". "), c)), gold,
        by={"source": F.col("source")}, keep=runner.text_only(F.when(F.col("doc_id") % 7 == 0, F.lit("picture"))), task="source" if limited else None,
    )


def heldout_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.answered(table(spark, sf_dir, "documents"), _run(False), hash_score).select("doc_id", "pred", "gold", "margin", "correct")


def heldout_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runner.accuracy(runner.answered(table(spark, sf_dir, "documents"), _run(False), hash_score), ["source"]))


def heldout_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of at most 100 rows of each task, as the runner takes them."""
    return rounded(runner.accuracy(runner.answered(table(spark, sf_dir, "documents"), _run(True), hash_score), ["source"]))


def _tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "documents").select("doc_id", "lang")
    create = lambda n: {side: F.concat_ws("|", F.lit(side), F.col("doc_id").cast("string"), F.lit(str(n))) for side in ("target", "retain")}
    check = lambda target, retain: F.when(digit(target) < 5, F.lit("target too short"))
    judge = lambda target, retain: F.when(digit(retain) > 0, digit(retain) < 6)
    return generation.attempts(seeds, create, check, judge)


def generated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tried(spark, sf_dir)


def generation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(generation.statistics(_tried(spark, sf_dir), ["lang"]))


def revalidated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revalidated(spark, sf_dir).where(~F.col("flagged")).select("doc_id", "lang")


def rejected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revalidated(spark, sf_dir).where("flagged").select("doc_id", "lang", "_revalidation_reason")


def _revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = vote_rows(spark, sf_dir).select("doc_id", "judge", "vote", "error", F.concat(F.col("judge"), F.lit(" flags it")).alias("reason"))
    return generation.revalidated(table(spark, sf_dir, "documents").select("doc_id", "lang"), votes, "doc_id")


def cached_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the verdicts are in the cache, with marks of their own: each twice, and some of them for another answer."""
    answers = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    seen = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("earlier "), F.col("text"))).otherwise(F.col("text"))
    marks = F.explode(F.array(F.lit("cached"), F.lit("cached later")))
    cache = answers.where("doc_id % 3 = 0").select("doc_id", generation.answer_hash(seen).alias("answer_hash"), marks.alias("verdict"))
    judge = lambda rows: rows.withColumn("verdict", F.when(digit(F.col("doc_id")) < 8, "yes").otherwise("no"))
    return generation.cached_verdicts(answers, cache, ["doc_id"], judge, text="text").drop("text")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines and back, texts whole."""
    path = scratch(spark, "json-lines")
    sinks.json_overwrite(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return scans.json_lines(spark, path, "doc_id long, text string, lang string")


def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends that overlap: the second adds only what is new."""
    path, rows = scratch(spark, "append"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sinks.append_new(rows.where("o_orderkey % 3 > 0"), path, ["o_orderkey"], spark)
    sinks.append_new(rows.where("o_orderkey % 2 > 0"), path, ["o_orderkey"], spark)
    return spark.read.parquet(path)


def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "routed")
    sinks.routed(table(spark, sf_dir, "documents").select("doc_id", "source"), path, digit(F.col("doc_id")) < 2)
    return spark.read.parquet(path).select("doc_id", "source", "split")


def dropped_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered copy: what it kept, with the counts it reports."""
    path, docs = scratch(spark, "kept"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    kept, dropped = sinks.filtered_copy(docs, docs.where(digit(F.col("doc_id")) < 3).select("doc_id"), "doc_id", path)
    return spark.read.parquet(path).select("doc_id", "lang", F.lit(kept).cast("long").alias("kept"), F.lit(dropped).cast("long").alias("dropped"))


QUERIES = {f.__name__: f for f in (heldout_answers, heldout_accuracy, heldout_limited, generated_pairs, generation_counts, revalidated_pairs, rejected_pairs, cached_verdicts, json_round_trip, appended_once, routed_rows, dropped_copy)}

ANSWERS = """c AS (SELECT * FROM (VALUES (0, 'A. de'), (1, 'B. en'), (2, 'C. es'), (3, 'D. fr')) t(k, choice)),
d AS (SELECT *, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS gold, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE doc_id % 7 <> 0),
s AS (SELECT doc_id, source, gold, k, CAST(('0x' || substr(md5('0|Text: ' || coalesce(text, '') || chr(10) || 'Which of A to D is its language?|' || choice), 1, 6)) AS BIGINT) AS score
      FROM d, c WHERE gold IS NOT NULL AND {0}),
a AS (SELECT doc_id, source, CAST(gold AS INTEGER) AS gold, CAST(arg_min(k, (-score, k)) AS INTEGER) AS pred, max(score) FILTER (k = gold) - max(score) FILTER (k <> gold) AS margin FROM s GROUP BY doc_id, source, gold)"""
HELD = "SELECT source, count(*) AS n, count(*) FILTER (pred = gold) AS n_correct, round(avg(margin), 6) AS mean_margin, round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy FROM a GROUP BY source"
TRIED = """t AS (SELECT doc_id, lang, n, CAST(('0x' || substr(md5('0|target|' || doc_id || '|' || n), 1, 1)) AS INTEGER) AS dt, CAST(('0x' || substr(md5('0|retain|' || doc_id || '|' || n), 1, 1)) AS INTEGER) AS dr
      FROM documents, generate_series(1, 3) g(n)),
o AS (SELECT *, CASE WHEN dt < 5 THEN 'target too short' WHEN dr > 0 AND dr < 6 THEN 'rejected' ELSE 'accepted' END AS outcome FROM t),
f AS (SELECT doc_id, lang, coalesce(min(n) FILTER (outcome = 'accepted'), 3) AS attempt FROM o GROUP BY doc_id, lang),
p AS (SELECT f.doc_id, f.lang, CAST(f.attempt AS INTEGER) AS attempt, 'target|' || f.doc_id || '|' || f.attempt AS target, 'retain|' || f.doc_id || '|' || f.attempt AS retain, o.outcome FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.attempt)"""
DIGIT = "CAST(('0x' || substr(md5('0|' || {0}), 1, 1)) AS INTEGER)"

ORACLES = {
    "heldout_answers": f"WITH {ANSWERS.format('true')} SELECT doc_id, pred, gold, margin, pred = gold AS correct FROM a",
    "heldout_accuracy": f"WITH {ANSWERS.format('true')} {HELD}",
    "heldout_limited": f"WITH {ANSWERS.format('r <= 100')} {HELD}",
    "generated_pairs": f"WITH {TRIED} SELECT * FROM p",
    "generation_counts": f"""WITH {TRIED} SELECT lang, count(*) AS n, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'accepted' AND attempt = 1) AS at_once, count(*) FILTER (outcome = 'rejected') AS rejected,
        count(*) FILTER (outcome = 'target too short') AS failed, round(avg(attempt), 6) AS mean_attempts FROM p GROUP BY lang""",
    "revalidated_pairs": f"WITH {VOTES_SQL} SELECT doc_id, lang FROM votes GROUP BY doc_id, lang HAVING count(*) FILTER (vote AND NOT error) < count(*) // 2 + 1",
    "rejected_pairs": f"""WITH {VOTES_SQL} SELECT doc_id, lang, string_agg(judge || ' flags it', '; ' ORDER BY judge) FILTER (vote AND NOT error) AS _revalidation_reason
        FROM votes GROUP BY doc_id, lang HAVING count(*) FILTER (vote AND NOT error) >= count(*) // 2 + 1""",
    "cached_verdicts": f"SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 AND (doc_id % 9 <> 0 OR text IS NULL) THEN 'cached' WHEN {DIGIT.format('doc_id')} < 8 THEN 'yes' ELSE 'no' END AS verdict FROM documents",
    "json_round_trip": "SELECT doc_id, text, lang FROM documents",
    "appended_once": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 2 > 0",
    "routed_rows": f"SELECT doc_id, source, CASE WHEN {DIGIT.format('doc_id')} < 2 THEN 'holdout' ELSE 'train' END AS split FROM documents",
    "dropped_copy": f"SELECT doc_id, lang, count(*) OVER () AS kept, (SELECT count(*) FROM documents WHERE {DIGIT.format('doc_id')} < 3) AS dropped FROM documents WHERE {DIGIT.format('doc_id')} >= 3",
}
