"""The thin ``opN_*`` queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, hash_forest, html_extraction, language_id, lm_scoring, maxscore, merkle, mixing, packing, quality_rules, simhash, token_files, warc
from .common import fresh_path, id_remainder
from .collocations_sql import OP13_SQL
from .merkle_sql import OP11_SQL
from .mixing_sql import OP4_SQL
from .quality_rules_sql import OP12_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine; it is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(table(spark, sf_dir, "documents"))


def op5_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op6_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), uri)
    return warc.read(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op9_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_path(spark, "token-ids")
    token_files.write(table(spark, sf_dir, "documents"), uri, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, uri)


def op10_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, id_remainder(F.col("doc_id"), 10) == 0, vocabulary("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=id_remainder(F.col("doc_id"), 3) == 0)


def op12_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxscore": op1_maxscore,
    "op2_hash_forest": op2_hash_forest,
    "op3_language_id": op3_language_id,
    "op4_temperature_mixing": op4_temperature_mixing,
    "op5_covering_simhash": op5_covering_simhash,
    "op6_warc_writer": op6_warc_writer,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_site_templates": op8_site_templates,
    "op9_range_coded_ids": op9_range_coded_ids,
    "op10_lattice_scoring": op10_lattice_scoring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_adaptive_quality": op12_adaptive_quality,
    "op13_collocations": op13_collocations,
}

OP1_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
terms AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS t FROM whole),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM terms q JOIN terms c ON q.t = c.t AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP6_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""

ORACLES: dict[str, str] = {
    "op1_maxscore": OP1_SQL,
    "op4_temperature_mixing": OP4_SQL,
    "op6_warc_writer": OP6_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_adaptive_quality": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
