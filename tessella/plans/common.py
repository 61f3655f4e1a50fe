"""Tables of the queries, and adapters that read them as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import order_key
from ..functions.text import WHITE

QUERIES: dict = {}
ORACLES: dict = {}

JUDGES = ("a", "b", "c")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digit(*parts: Column, at: int = 1) -> Column:
    """A number from 0 to 15 that depends on the parts alone."""
    return F.conv(F.substring(order_key(*parts), at, 1), 16, 10).cast("int")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges on every document, from hashes: vote, error, evidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    judges = F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.lit(k).alias("judge_order")) for k, j in enumerate(JUDGES)]))
    rows = docs.withColumn("j", judges).select("doc_id", "lang", "source", "j.judge", "j.judge_order")
    d1, d2 = digit(F.col("doc_id"), F.col("judge"), at=1), digit(F.col("doc_id"), F.col("judge"), at=2)
    evidence = F.transform(F.sequence(F.lit(1), F.lit(1) + d1), lambda i: F.concat(F.col("judge"), i.cast("string")))
    return rows.withColumns({"vote": F.when(d2 != 0, d1 < 6), "error": d2 == 0, "evidence": evidence})


def stripped(x: str) -> str:
    """``text.strip`` as SQL."""
    return f"trim({x}, '{WHITE}')"


VOTES_SQL = """votes AS (
  SELECT doc_id, lang, source, judge, judge_order, d1, d2, CASE WHEN d2 <> 0 THEN d1 < 6 END AS vote, d2 = 0 AS error,
         list_transform(generate_series(1, 1 + d1), lambda i: judge || i) AS evidence
  FROM (SELECT d.doc_id, d.lang, d.source, j.judge, j.judge_order,
               CAST(('0x' || substr(md5('0|' || doc_id || '|' || judge), 1, 1)) AS INTEGER) AS d1,
               CAST(('0x' || substr(md5('0|' || doc_id || '|' || judge), 2, 1)) AS INTEGER) AS d2
        FROM documents d, (VALUES ('a', 0), ('b', 1), ('c', 2)) j(judge, judge_order)))"""


def graded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as verdicts: quality grades the target side, the absence of toxicity the retain side; some are missing."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    lost = digit(F.col("doc_id")) == 0
    return rows.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("target_ok"), F.when(~lost, F.col("toxic") == 0).alias("retain_ok"))


GRADED_SQL = """graded AS (
  SELECT doc_id, lang, source, quality = 1 AS target_ok,
         CASE WHEN substr(md5('0|' || doc_id), 1, 1) <> '0' THEN toxic = 0 END AS retain_ok
  FROM labels JOIN documents USING (doc_id))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as models: nation is the family, market segment the primitive, balance the size, order totals the scores."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("t"), F.stddev_pop("o_totalprice").alias("s"), F.count("*").alias("k"))
    rows = orders.join(table(spark, sf_dir, "customer"), "c_custkey")
    x = F.log10(F.abs(F.col("c_acctbal")) + 10.0)
    return rows.select(
        F.col("c_custkey").alias("model"), F.col("c_nationkey").alias("family"), F.col("c_mktsegment").alias("primitive"), (F.abs("c_acctbal") + 10.0).alias("size_b"), x.alias("log_params"),
        (F.col("t") / 1e6).alias("target"), (F.col("s") / 1e6).alias("retain"), ((F.col("t") - F.col("s")) / 1e6).alias("ca"),
    )


OBSERVATIONS_SQL = """observations AS (
  SELECT c_custkey AS model, c_nationkey AS family, c_mktsegment AS primitive, abs(c_acctbal) + 10.0 AS size_b,
         log10(abs(c_acctbal) + 10.0) AS log_params, t / 1e6 AS target, s / 1e6 AS retain, (t - s) / 1e6 AS ca
  FROM (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS t, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1) JOIN customer USING (c_custkey))"""


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; minus zero is zero."""
    return rows.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])
