"""Evaluation: votes, contrastive accuracy, choices, graders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import graders
from ..functions import text as T
from ..functions import vectors as V
from ..operators import accuracy, choice, votes
from .common import GRADED_SQL, VOTES_SQL, digit, graded_pairs, observations, rounded, table
from .common import OBSERVATIONS_SQL as OBS
from .common import votes as vote_rows

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def judge_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.panel(vote_rows(spark, sf_dir), ["doc_id"])


def judge_null_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.null_strict(vote_rows(spark, sf_dir), ["doc_id"])


def judge_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.unanimous(vote_rows(spark, sf_dir).where("judge <> 'c'"), ["doc_id"])


def judge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.evidence(vote_rows(spark, sf_dir), ["doc_id"], "judge_order").select("doc_id", F.array_join("evidence", ",").alias("evidence"))


def judge_dissent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vote_rows(spark, sf_dir)
    return votes.dissent(rows, votes.panel(rows, ["doc_id"]), ["doc_id"])


def consensus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.consensus(votes.panel(vote_rows(spark, sf_dir), ["doc_id", "lang"]), ["lang"])


def verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.col("judge"), F.lit("="), F.when(F.col("error"), "ERROR").when(F.col("vote"), "TRUE").otherwise("FALSE"))
    log = vote_rows(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), "; ").alias("reason"))
    return votes.from_reasons(log)


def rejection_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.rejection_by(votes.panel(vote_rows(spark, sf_dir), ["doc_id", "source"]), "source", 5)


def calibration_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.lit("target").alias("side"), F.col("target_ok").alias("verdict")), F.struct(F.lit("retain").alias("side"), F.col("retain_ok").alias("verdict"))))
    rows = graded_pairs(spark, sf_dir).withColumn("s", sides).select("lang", "s.side", "s.verdict")
    return rounded(votes.calibration(rows, ["lang"]))


def contrastive_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.contrastive(graded_pairs(spark, sf_dir), ["lang"], []))


def ca_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.contrastive(graded_pairs(spark, sf_dir), ["lang"], ["source"]))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(F.col("family").alias("model"), "primitive").agg(F.avg("ca").alias("ca"))


def ca_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.pivot(_long(spark, sf_dir), ["model"], "primitive", ["ca"], SEGMENTS))


def ca_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = accuracy.pivot(_long(spark, sf_dir), ["model"], "primitive", ["ca"], SEGMENTS).withColumnsRenamed({s: f"{s}_CA" for s in SEGMENTS})
    return rounded(accuracy.unpivot(wide, ["model"], [f"{s}_CA" for s in SEGMENTS]))


def bias_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.bias_corrected(_long(spark, sf_dir), {"BUILDING": 0.14, "MACHINERY": 0.22, "FURNITURE": 0.0}))


def profile_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy.profile(_long(spark, sf_dir)))


def tier_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model"), F.col("n_regionkey").alias("tier"))
    return rounded(accuracy.tier_means(_long(spark, sf_dir).where("ca > 0.075"), models, "tier", SEGMENTS))


def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return rows.groupBy(accuracy.quadrant(F.col("ca"), F.col("target") * 3).alias("quadrant")).agg(F.count("*").alias("n"))


def primitive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.counts_per_primitive(observations(spark, sf_dir))


def deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = accuracy.pivot(_long(spark, sf_dir), ["model"], "primitive", ["ca"], SEGMENTS).withColumnsRenamed({s: f"{s}_CA" for s in SEGMENTS})
    return rounded(accuracy.deficits(wide, ["model"], [f"{s}_CA" for s in SEGMENTS]))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector scored against the centroid of every label, whole thousandths so that ties occur."""
    rows = table(spark, sf_dir, "embeddings")
    center = V.centroids(rows, "label", "embedding").select(F.col("label").alias("choice_idx"), "centroid")  # a row for each label
    items = rows.select("vec_id", F.col("label").alias("gold_idx"), V.doubles(F.col("embedding")).alias("v"))
    return items.crossJoin(F.broadcast(center)).select("vec_id", "gold_idx", "choice_idx", F.floor(100 * V.dot(F.col("v"), F.col("centroid")) + 0.0000001).cast("double").alias("score"))


def argmax_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.graded(_scores(spark, sf_dir), ["vec_id"])


def argmax_gold_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.graded(_scores(spark, sf_dir), ["vec_id"], gold_wins_ties=True).select("vec_id", "correct", "margin")


def grouped_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = choice.accuracy_by(choice.graded(_scores(spark, sf_dir), ["vec_id"]), ["gold_idx"])
    return rounded(found.select("gold_idx", F.col("grouping").cast("long").alias("grouping"), "n", "correct", "accuracy"))


def micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = choice.accuracy_by(choice.graded(_scores(spark, sf_dir), ["vec_id"]), ["gold_idx"]).where("grouping = 0")
    return rounded(choice.micro_average(per))


def reduced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (-F.length("text")).cast("double").alias("s"), T.word_count(F.col("text")).alias("n"), F.octet_length("text").alias("b"))
    return rounded(docs.select("doc_id", *[choice.reduced(F.col("s"), F.col("n"), F.col("b"), how).alias(how) for how in ("sum", "mean", "byte_mean")]))


def perplexity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = choice.perplexity_windows(docs, T.word_count(F.col("text")))
    return found.select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), F.col("scored").cast("long").alias("scored"))


def both_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("len", F.length("text").cast("long"))
    return choice.both_conditions(turns, ["conv_id"], "role", ["user", "assistant", "system"], F.col("len"))


def task_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: five rows of every task."""
    return choice.per_task_limit(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


def grader_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grader on every document: the answer is its whole text, the reference that of the document with the next id (none for the last)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"))
    docs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("r")), "doc_id", "left")
    marks = {name: g(F.col("a"), F.col("r")) for name, g in graders.GRADERS.items()}
    return docs.select("doc_id", *[m.alias(name) for name, m in marks.items()])


def last_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", graders.last_number(F.col("text"), graders.PLAIN_NUMBER).alias("number")).where("number is not null")


def verdict_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of every kind, by hash."""
    kinds = ['{"correct": true}', '{"correct":FALSE}', "YES, it is", " no.", "I think yes", "well", '"Correct" : true', "the answer is no"]
    reply = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("doc_id").cast("int") % 8 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", graders.verdict(reply).alias("v1"), graders.verdict_by_words(reply).alias("v2"))


def label_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("True", "deceptive", " yes", "NO", "maybe", "Yes/No", "find relation", "")]), digit(F.col("doc_id")) % 8 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", choice.truth_label(raw).alias("label"), choice.question_type(raw).alias("kind"), choice.numeric_order(F.when(F.col("doc_id") % 2 == 0, F.substring("source", 4, 9)).otherwise(F.col("source"))).alias("place"))


QUERIES = {f.__name__: f for f in (judge_majority, judge_null_strict, judge_unanimous, judge_evidence, judge_dissent, consensus_stats, verdict_log, rejection_top, calibration_delta, contrastive_accuracy, ca_by_cell, ca_pivot, ca_unpivot, bias_corrected, profile_average, tier_means, quadrants, primitive_counts, deficits, argmax_choice, argmax_gold_ties, grouped_accuracy, micro_average, reduced_scores, perplexity_windows, both_conditions, task_limits, grader_results, last_numbers, verdict_parses, label_cases)}

PANEL = f"""{VOTES_SQL}, panel AS (
  SELECT doc_id, lang, source, count(*) AS n_judges, count(*) FILTER (vote AND NOT error) AS n_flagged FROM votes GROUP BY ALL), verdicts AS (
  SELECT *, n_flagged >= 2 AS flagged, CASE WHEN n_flagged = 0 THEN 'all_clean' WHEN n_flagged < 2 THEN 'one_dissent' ELSE 'majority_reject' END AS agreement, n_flagged = 2 AS borderline FROM panel)"""
CA = """count(*) FILTER (target_ok IS NOT NULL AND retain_ok IS NOT NULL) AS total_pairs, count(*) FILTER (target_ok IS NULL OR retain_ok IS NULL) AS skipped,
  round(coalesce(count(*) FILTER (target_ok AND retain_ok IS NOT NULL) / nullif(count(*) FILTER (target_ok IS NOT NULL AND retain_ok IS NOT NULL), 0), 0), 6) AS acc_target,
  round(coalesce(count(*) FILTER (retain_ok AND target_ok IS NOT NULL) / nullif(count(*) FILTER (target_ok IS NOT NULL AND retain_ok IS NOT NULL), 0), 0), 6) AS acc_retain,
  round(coalesce((count(*) FILTER (target_ok AND retain_ok IS NOT NULL) - count(*) FILTER (retain_ok AND target_ok IS NOT NULL)) / nullif(count(*) FILTER (target_ok IS NOT NULL AND retain_ok IS NOT NULL), 0), 0), 6) AS contrastive_accuracy"""
LONG = f"{OBS}, long AS (SELECT family AS model, primitive, avg(ca) AS ca FROM observations GROUP BY ALL)"
SCORES = """parts AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
centers AS (SELECT label, list(x ORDER BY p) AS c FROM (SELECT label, p, avg(x) AS x FROM parts GROUP BY ALL) GROUP BY label),
scores AS (SELECT vec_id, e.label AS gold_idx, c.label AS choice_idx, floor(100 * list_dot_product(CAST(embedding AS DOUBLE[]), c.c) + 0.0000001) AS score FROM embeddings e, centers c),
graded AS (SELECT vec_id, arg_max(choice_idx, (score, -choice_idx)) AS pred_idx, any_value(gold_idx) AS gold_idx, max(score) FILTER (choice_idx = gold_idx) AS gold_logp,
                  max(score) FILTER (choice_idx <> gold_idx) AS best_other_logp FROM scores GROUP BY vec_id)"""

ORACLES = {
    "judge_majority": f"WITH {PANEL} SELECT doc_id, n_judges, n_flagged, flagged, agreement, borderline FROM verdicts",
    "judge_null_strict": f"WITH {VOTES_SQL} SELECT doc_id, CASE WHEN count(*) FILTER (vote IS NULL) = 0 THEN count(*) FILTER (vote) >= count(*) // 2 + 1 END AS verdict FROM votes GROUP BY doc_id",
    "judge_unanimous": f"WITH {VOTES_SQL} SELECT doc_id, CASE WHEN count(*) FILTER (vote IS NULL) = 0 THEN bool_and(vote) END AS verdict FROM votes WHERE judge <> 'c' GROUP BY doc_id",
    "judge_evidence": f"WITH {VOTES_SQL} SELECT doc_id, array_to_string(list_slice(flatten(list(list_slice(evidence, 1, 5) ORDER BY judge_order)), 1, 10), ',') AS evidence FROM votes WHERE vote GROUP BY doc_id",
    "judge_dissent": f"""WITH {PANEL} SELECT judge, count(*) FILTER (CASE WHEN flagged THEN NOT coalesce(vote, false) AND NOT error ELSE coalesce(vote, false) AND NOT error END) AS dissents,
        count(*) FILTER (vote AND NOT error) AS flags, count(*) AS n, round(count(*) FILTER (vote AND NOT error) / count(*), 4) AS flag_rate FROM votes JOIN verdicts USING (doc_id) GROUP BY judge""",
    "consensus_stats": f"""WITH {PANEL} SELECT lang, count(*) AS total, count(*) FILTER (agreement = 'all_clean') AS all_clean, count(*) FILTER (agreement = 'one_dissent') AS one_dissent,
        count(*) FILTER (agreement = 'majority_reject') AS majority_reject, count(*) FILTER (NOT flagged) AS passed, count(*) FILTER (borderline) AS borderline,
        round(count(*) FILTER (flagged) / count(*), 4) AS rejection_rate FROM verdicts GROUP BY lang""",
    "verdict_log": f"""WITH {VOTES_SQL}, log AS (SELECT doc_id, bool_or(error) AS e, count(*) FILTER (vote) AS t FROM votes GROUP BY doc_id)
        SELECT count(*) AS total, count(*) FILTER (NOT e AND t = 0) AS all_clean, count(*) FILTER (NOT e AND t = 1) AS one_dissent, count(*) FILTER (NOT e AND t >= 2) AS majority_reject FROM log""",
    "rejection_top": f"WITH {PANEL} SELECT source, count(*) AS n, count(*) FILTER (flagged) AS rejected, round(count(*) FILTER (flagged) / count(*), 4) AS rate FROM verdicts GROUP BY source ORDER BY rate DESC, source LIMIT 5",
    "calibration_delta": f"""WITH {GRADED_SQL}, m AS (SELECT lang, avg(CAST(target_ok AS INTEGER)) AS t, avg(CAST(retain_ok AS INTEGER)) AS r FROM graded GROUP BY lang)
        SELECT lang, round(t, 6) AS target_rate, round(r, 6) AS retain_rate, round(round(100.0 * (t - r), 1), 6) AS delta_pp,
               CASE WHEN abs(round(100.0 * (t - r), 1)) < 5 THEN 'none' ELSE 'subtract ' || printf('%+.1f', round(100.0 * (t - r), 1)) || ' pp' END AS action FROM m""",
    "contrastive_accuracy": f"WITH {GRADED_SQL} SELECT lang, 'all' AS level, {CA} FROM graded GROUP BY lang",
    "ca_by_cell": f"WITH {GRADED_SQL} SELECT lang, source, CASE WHEN grouping(source) = 1 THEN 'all' ELSE 'cell' END AS level, {CA} FROM graded GROUP BY GROUPING SETS ((lang, source), (lang))",
    "ca_pivot": f"WITH {LONG} SELECT model, " + ", ".join(f"round(max(ca) FILTER (primitive = '{s}'), 6) AS {s}" for s in SEGMENTS) + " FROM long GROUP BY model",
    "ca_unpivot": f"WITH {LONG} SELECT model, primitive, round(ca, 6) AS ca FROM long WHERE ca IS NOT NULL",
    "bias_corrected": f"WITH {LONG} SELECT model, primitive, round(ca, 6) AS ca, d AS delta, round(ca - d, 6) AS ca_corrected FROM long JOIN (VALUES ('BUILDING', CAST(0.14 AS DOUBLE)), ('MACHINERY', 0.22), ('FURNITURE', 0.0)) b(primitive, d) USING (primitive)",
    "profile_average": f"WITH {LONG} SELECT model, round(avg(ca), 6) AS profile, count(ca) AS coverage FROM long GROUP BY model",
    "tier_means": f"""WITH {LONG} SELECT n_regionkey AS tier, p.primitive, round(avg(coalesce(ca, 0)), 6) AS mean_ca FROM nation
        CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) p(primitive)
        LEFT JOIN (SELECT * FROM long WHERE ca > 0.075) l ON l.model = n_nationkey AND l.primitive = p.primitive GROUP BY ALL""",
    "quadrants": f"""WITH {OBS} SELECT CASE WHEN ca >= 0.10 AND target * 3 >= 0.50 THEN 'discriminating' WHEN ca >= 0.10 THEN 'selective' WHEN target * 3 >= 0.50 THEN 'indiscriminate' ELSE 'weak' END AS quadrant,
        count(*) AS n FROM observations GROUP BY 1""",
    "primitive_counts": f"""WITH {OBS}, f AS (SELECT primitive, family, count(DISTINCT size_b) AS sizes FROM observations GROUP BY ALL)
        SELECT primitive, n_obs, CAST(n_models AS INTEGER) AS n_models, n_families, n_families_multi_scale FROM (SELECT primitive, count(*) AS n_obs, count(DISTINCT model) AS n_models FROM observations GROUP BY primitive)
        JOIN (SELECT primitive, count(*) AS n_families, count(*) FILTER (sizes >= 2) AS n_families_multi_scale FROM f GROUP BY primitive) USING (primitive)""",
    "deficits": f"WITH {LONG} SELECT model, primitive, round(ca, 6) AS ca, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ca, primitive) AS r FROM long WHERE ca IS NOT NULL) WHERE r <= 2",
    "argmax_choice": f"WITH {SCORES} SELECT vec_id, pred_idx, gold_idx, gold_logp, best_other_logp, gold_logp - best_other_logp AS margin, pred_idx = gold_idx AS correct FROM graded",
    "argmax_gold_ties": f"WITH {SCORES} SELECT vec_id, gold_logp >= best_other_logp AS correct, gold_logp - best_other_logp AS margin FROM graded",
    "grouped_accuracy": f"WITH {SCORES} SELECT gold_idx, CAST(grouping(gold_idx) AS BIGINT) AS grouping, count(*) AS n, count(*) FILTER (pred_idx = gold_idx) AS correct, round(count(*) FILTER (pred_idx = gold_idx) / count(*), 6) AS accuracy FROM graded GROUP BY ROLLUP (gold_idx)",
    "micro_average": f"WITH {SCORES} SELECT count(*) FILTER (pred_idx = gold_idx) AS correct, count(*) AS n, round(count(*) FILTER (pred_idx = gold_idx) / count(*), 6) AS accuracy FROM graded",
    "reduced_scores": r"""WITH d AS (SELECT doc_id, -length(text) AS s, len(regexp_extract_all(text, '\S+')) AS n, strlen(text) AS b FROM documents)
        SELECT doc_id, CAST(CASE WHEN n > 0 THEN s ELSE '-inf' END AS DOUBLE) AS sum, round(CASE WHEN n > 0 THEN s / n ELSE CAST('-inf' AS DOUBLE) END, 6) AS mean, round(CASE WHEN n > 0 THEN s / b ELSE CAST('-inf' AS DOUBLE) END, 6) AS byte_mean FROM d""",
    "perplexity_windows": r"""WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n FROM documents),
        w AS (SELECT doc_id, n, unnest(generate_series(0, n - 1, 512)) AS begin FROM d WHERE n > 0),
        e AS (SELECT doc_id, n, begin, least(begin + 1024, n) AS "end", CASE WHEN begin = 0 THEN 0 ELSE least(begin + 512, n) END AS before FROM w)
        SELECT doc_id, begin, "end", "end" - before AS scored FROM e WHERE begin = 0 OR before < n""",
    "both_conditions": """SELECT * FROM (SELECT conv_id, max(length(text)) FILTER (role = 'user') AS user, max(length(text)) FILTER (role = 'assistant') AS assistant, max(length(text)) FILTER (role = 'system') AS system
        FROM conversations GROUP BY conv_id) WHERE "user" IS NOT NULL AND assistant IS NOT NULL AND system IS NOT NULL""",
    "task_limits": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5",
    "last_numbers": r"SELECT * FROM (SELECT doc_id, try_cast(list_extract(regexp_extract_all(text, '-?\d+(?:\.\d+)?'), -1) AS DOUBLE) AS number FROM documents) WHERE number IS NOT NULL",
    "verdict_parses": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 6 THEN true END AS v1,
        CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN true END AS v2 FROM documents""",
    "label_cases": """WITH d AS (SELECT doc_id, source, CAST(('0x' || substr(md5('0|' || doc_id), 1, 1)) AS INTEGER) % 8 AS k FROM documents)
        SELECT doc_id, CASE WHEN k IN (0, 2) THEN 'truthful' WHEN k IN (1, 3) THEN 'deceptive' END AS label,
               CASE k WHEN 0 THEN 'TRUE' WHEN 1 THEN 'DECEPTIVE' WHEN 2 THEN 'YES' WHEN 3 THEN 'NO' WHEN 4 THEN 'MAYBE' WHEN 5 THEN 'YN' WHEN 6 THEN 'FR' ELSE 'unknown' END AS kind, CASE WHEN doc_id % 2 = 0 THEN CAST(substr(source, 4) AS INTEGER) ELSE 99 END AS place FROM d""",
}
