"""Further columns take no part in any operator, whatever they are called: results are those without them."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import html_extraction, language_id, lm_scoring, packing, simhash, token_files, warc
from tessella.llm.common import id_remainder
from tessella.llm.queries import vocabulary

NAMES = ("fp", "fp2", "n", "digest", "component_id", "first", "root", "vertex", "shard", "seq", "kind", "refers_to", "payload", "n_bytes", "ids", "length", "piece", "start", "bucket", "rank", "host", "hash", "word", "c", "score", "lang_pred", "held_out", "row", "key", "at", "tokens", "url_", "salt")


def plain(df):
    return sorted(map(str, df.collect()))


def clashing(df):
    for c in NAMES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0)], rows.schema)
    return rows.unionByName(odd).unionByName(rows.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 5000)).cache()


def test_documents(spark, docs, tmp_path):
    two = clashing(docs)
    same = lambda f: plain(f(docs)) == plain(f(two))
    assert same(simhash.near_duplicates) and same(simhash.similar_documents)
    assert same(lambda d: packing.pack(d, vocabulary("byte_bpe_50k.json")).drop("sequence_id", "offset"))
    assert same(lambda d: lm_scoring.score(d, id_remainder(F.col("doc_id"), 10) == 0, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens", "n_known", "base_score", F.round("score", 6)))
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    assert same(lambda d: language_id.identify(d.select("doc_id", "text"), model))
    assert sorted(r["doc_id"] for r in language_id.accepted(docs, model).collect()) == sorted(r["doc_id"] for r in language_id.accepted(two, model).collect())
    for k, d in enumerate((docs, two)):
        token_files.write(d, f"file://{tmp_path}/ids{k}", vocabulary("word_bpe_49k.json"), end_id=1)
    assert plain(token_files.read(spark, f"file://{tmp_path}/ids0")) == plain(token_files.read(spark, f"file://{tmp_path}/ids1"))
    kept = simhash.first_of_each(two)
    assert kept.columns == two.columns and {r["fp"] for r in kept.collect()} == {"clash"}


def test_pages(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    two = clashing(pages)
    columns = ["page_id", "url", "text", "n_chars"]
    assert plain(html_extraction.extract(pages).select(columns)) == plain(html_extraction.extract(two).select(columns))
    for k, d in enumerate((pages, two)):
        warc.write(d, f"file://{tmp_path}/warc{k}")
    assert plain(warc.read(spark, f"file://{tmp_path}/warc0")) == plain(warc.read(spark, f"file://{tmp_path}/warc1"))
