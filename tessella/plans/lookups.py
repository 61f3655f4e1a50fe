"""Selections and look-ups on the test tables, and a benchmark whose scorer is fitted to the tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..joins import scratch
from ..operators import choice, selection
from .common import GRADED_SQL, digit, graded_pairs, observations, rounded, table
from .common import OBSERVATIONS_SQL as OBS

LANGUAGES = ("de", "en", "es", "fr")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


#: Words that are broadcast with their shares take at most about so many bytes; rarer ones are joined by a shuffle.
OFTEN_BYTES = 32 << 20


def least_count(counts: DataFrame, limit: int) -> int:
    """The least power of two of which all words that occur as often (column ``n``) fit into ``limit`` bytes together."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.sum(F.octet_length("word") + 100).alias("bytes")).collect()
    held, least = 0, 1 << 62
    for r in sorted(sizes, reverse=True):  # a row for each power of two
        held += r["bytes"]
        if held > limit:
            return least
        least = 1 << (r["bits"] - 1)
    return 1


def language_scores(spark: SparkSession, sf_dir: str, often_bytes: int = OFTEN_BYTES) -> DataFrame:
    """(doc_id, source, choice_idx, gold_idx, score): the log probability of each document's words in each language, from smoothed counts of all documents' words.

    A score is a sum over words, so documents' words are not stored or counted
    first: shares of frequent words come by a broadcast and are summed where
    the text is read; only what is left, a small part of all words, is
    shuffled.
    """
    key, path = ["doc_id", "source", "lang"], scratch(spark, "word-counts")
    words = table(spark, sf_dir, "documents").select(*key, F.explode(F.split(F.lower("text"), T.SPACES)).alias("word")).where("word <> ''")
    words.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("lang") == x).alias(f"c_{x}") for x in LANGUAGES]).write.parquet(path)
    counts = spark.read.parquet(path)
    total = counts.agg(F.count("*").alias("v"), *[F.sum(f"c_{x}").alias(f"n_{x}") for x in LANGUAGES]).first()
    share = lambda x: F.log((F.col(f"c_{x}") + 0.1) / F.lit(float((total[f"n_{x}"] or 0) + 0.1 * max(1, total["v"]))))
    least = least_count(counts, often_bytes)
    shares = lambda which: counts.where(which).select("word", *[share(x).alias(x) for x in LANGUAGES])
    often = F.broadcast(shares(F.col("n") >= least))
    found = words.join(often, "word")
    if least > 1:
        rest = words.join(often.select("word"), "word", "left_anti")
        found = found.unionByName(rest.join(shares(F.col("n") < least), "word"))
    scored = found.groupBy(*key).agg(*[F.round(F.sum(x), 4).alias(x) for x in LANGUAGES])
    each = F.posexplode(F.array(*LANGUAGES)).alias("choice_idx", "score")
    gold = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")).cast("int") - 1
    return scored.select("doc_id", "source", gold.alias("gold_idx"), each)


def language_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which language each document is scored highest in, with its margin."""
    found = choice.graded(language_scores(spark, sf_dir), ["doc_id", "source"])
    return found.select("doc_id", "pred_idx", "gold_idx", F.round("margin", 3).alias("margin"), "correct")


def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = choice.graded(language_scores(spark, sf_dir), ["doc_id", "source"])
    return rounded(choice.accuracy_by(found, ["source"]))


def quick_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graded_pairs(spark, sf_dir).withColumns({"target": F.when(digit(F.col("doc_id"), at=3) > 1, F.lit("t")).otherwise(""), "retain": F.when(digit(F.col("doc_id"), at=4) > 0, F.lit("r"))})
    return selection.quick_accuracy(rows, ["lang"])


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by segment; low means are missing."""
    means = observations(spark, sf_dir).groupBy(F.col("family").cast("string").alias("model"), "primitive").agg(F.round(F.avg("ca"), 6).alias("v"))
    wide = means.where("v > 0.02").groupBy("model").pivot("primitive", list(SEGMENTS)).agg(F.max("v"))
    return wide.withColumn("Avg", F.round(sum((F.coalesce(s, F.lit(0.0)) for s in SEGMENTS), F.lit(0.0)) / 5, 6))


def best_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the six nations that have most segments, then the highest average."""
    return selection.representatives(_wide(spark, sf_dir), "model", list(SEGMENTS), "Avg", ["1", "no nation"])


def placed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").cast("double").alias("bal"))
    return selection.positions(rows, ["s_nationkey"], "bal", "s_suppkey").select("s_nationkey", "s_suppkey", F.col("position").cast("long").alias("position"))


def chosen_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models: a kind of container is the hardware, the size the parameters."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("model"), F.col("p_size").cast("double").alias("size_b"), F.col("p_brand").alias("hardware"))
    return selection.models(rows, hardware="Brand#11", most_params=30).select("model", "size_b")


def cell_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seeds, the priciest balance of their nation's customers as worked examples, as text."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("cell"), "c_custkey", "c_name")
    seeds = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cell"))
    found = selection.with_examples(seeds, customers, ["cell"], "c_custkey", ["c_name"])
    block = selection.examples_block(F.col("examples"), lambda x, k: F.concat(F.lit("Example "), k.cast("string"), F.lit(": "), x["c_name"]), "Examples:\n", "\nNow yours.")
    return found.select("s_suppkey", F.size("examples").cast("long").alias("n"), block.alias("block"))


def question_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers each judge gets to each question."""
    answers = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("question"))
    return selection.by_question(answers, "question", ["a", "b"]).groupBy("judge", "question").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conv"))


def same_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations that trade in both directions as one."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 5).alias("b"))
    return rows.select("n_nationkey", selection.same_pair(F.col("a"), F.col("b"), F.lit(1), F.lit(3)).alias("same"))


QUERIES = {f.__name__: f for f in (language_choice, language_accuracy, quick_accuracy, best_covered, placed_models, chosen_models, cell_examples, question_judges, same_pairs)}

_SCORED = """w AS (SELECT doc_id, source, lang, word, count(*) AS c FROM (
          SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+')) AS word FROM documents) GROUP BY ALL),
        t AS (SELECT word, %s FROM w GROUP BY word),
        n AS (SELECT count(*) AS v, %s FROM t),
        s AS (SELECT doc_id, source, lang, %s FROM w JOIN t USING (word), n GROUP BY doc_id, source, lang),
        u AS (SELECT doc_id, source, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS gold_idx, unnest([0, 1, 2, 3]) AS choice_idx, unnest([de, en, es, fr]) AS score FROM s),
        g AS (SELECT doc_id, source, gold_idx, arg_min(choice_idx, (-score, choice_idx)) AS pred_idx, max(score) FILTER (choice_idx = gold_idx) - max(score) FILTER (choice_idx <> gold_idx) AS margin FROM u GROUP BY ALL)""" % (
    ", ".join(f"sum(c) FILTER (lang = '{x}') AS c_{x}" for x in LANGUAGES),
    ", ".join(f"sum(c_{x}) AS n_{x}" for x in LANGUAGES),
    ", ".join(f"round(sum(c * ln((coalesce(c_{x}, 0) + 0.1) / (n_{x} + 0.1 * v))), 4) AS {x}" for x in LANGUAGES),
)
_D = "CAST(('0x' || substr(md5('0|' || doc_id), {0}, 1)) AS INTEGER)"

ORACLES = {
    "language_choice": f"WITH {_SCORED} SELECT doc_id, CAST(pred_idx AS INTEGER) AS pred_idx, CAST(gold_idx AS INTEGER) AS gold_idx, round(margin, 3) AS margin, pred_idx = gold_idx AS correct FROM g",
    "language_accuracy": f"""WITH {_SCORED} SELECT source, CAST(CASE WHEN grouping(source) = 0 THEN 0 ELSE 1 END AS BIGINT) AS grouping, count(*) AS n, count(*) FILTER (pred_idx = gold_idx) AS correct,
        round(count(*) FILTER (pred_idx = gold_idx) / count(*), 6) AS accuracy FROM g GROUP BY ROLLUP (source)""",
    "quick_accuracy": f"""WITH {GRADED_SQL}, p AS (SELECT * FROM graded WHERE {_D.format(3)} > 1 AND {_D.format(4)} > 0)
        SELECT lang, count(*) AS n, round(count(*) FILTER (target_ok) / count(*), 4) AS target_acc, round(count(*) FILTER (retain_ok) / count(*), 4) AS retain_acc,
               round(count(*) FILTER (target_ok) / count(*) - count(*) FILTER (retain_ok) / count(*), 4) AS CA FROM p GROUP BY lang""",
    "best_covered": f"""WITH {OBS}, m AS (SELECT CAST(family AS VARCHAR) AS model, primitive, round(avg(ca), 6) AS v FROM observations GROUP BY ALL)
        SELECT model FROM m WHERE v > 0.02 GROUP BY model ORDER BY count(*) DESC, round(sum(v) / 5, 6) DESC, model LIMIT 6""",
    "placed_models": "SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_acctbal AS DOUBLE), s_suppkey) - 1 AS position FROM supplier",
    "chosen_models": "SELECT CAST(p_partkey AS VARCHAR) AS model, CAST(p_size AS DOUBLE) AS size_b FROM part WHERE p_brand = 'Brand#11' AND p_size <= 30",
    "cell_examples": r"""WITH e AS (SELECT c_nationkey AS cell, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_acctbal > 9900),
        b AS (SELECT cell, count(*) AS n, 'Examples:' || chr(10) || string_agg('Example ' || k || ': ' || c_name, chr(10) || chr(10) ORDER BY k) || chr(10) || 'Now yours.' AS block FROM e GROUP BY cell)
        SELECT s_suppkey, coalesce(n, 0) AS n, coalesce(block, '') AS block FROM supplier LEFT JOIN b ON s_nationkey = cell""",
    "question_judges": "SELECT judge, role AS question, count(*) AS n, count(DISTINCT conv_id) AS n_conv FROM conversations, (VALUES ('a'), ('b')) j(judge) GROUP BY judge, role",
    "same_pairs": "SELECT n_nationkey, list_sort([n_regionkey, n_nationkey % 5]) = [1, 3] AS same FROM nation",
}
