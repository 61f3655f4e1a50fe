"""The corpus pipeline: language ID, near-dedup, mixing, packing; each stage is written and read again by the next.

Defined cases, in every stage: an empty table gives an empty one; columns that
a stage does not need take no part, whatever they are called, and all stages but
the last return those of their input; rows that repeat an id stay apart where
their texts differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import language_id, mixing, packing, simhash
from tessella.llm.common import fresh_path, id_remainder
from tessella.llm.queries import table, vocabulary


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any text in a language go: null texts and such without a letter, and texts of at least ``language_id.EVIDENCE`` trigrams whose margin is below the model's bound. The model learns from the same labelled fold as the query; rows without a language or an id teach nothing."""
    model = language_id.train(docs.where(id_remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    return language_id.accepted(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id: 5-word shingles, Jaccard similarity of at least 0.8."""
    return simhash.first_of_each(docs, groups=simhash.similar_documents(docs, words=5, similarity=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of smaller sources up to twice; null is a source like any other."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there: null texts consist of the end id, repeated documents are packed each."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), kept=packing.KEPT_BESIDE)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_each),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The tokenizer and the support vector machines are beyond SQL.
ORACLE_SQL = None
