import corpus_pipeline
from tessella.llm import language_id, mixing, packing, simhash
from tessella.llm.queries import vocabulary


def test_stages_are_the_operators(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    junk = spark.createDataFrame([(900001, "123 456", "en", "s", 7), (900002, None, None, None, None)], base.schema)
    path = f"{tmp_path}/documents.parquet"
    base.unionByName(junk).unionByName(base.where("doc_id % 10 = 0").selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars")).write.parquet(path)
    docs = spark.read.parquet(path)
    names = docs.columns
    kept = corpus_pipeline.keep_known_languages(spark, docs, str(tmp_path))
    assert kept.columns == names and not {900001, 900002} & {r["doc_id"] for r in kept.collect()}
    assert kept.count() == docs.count() - 2
    single = corpus_pipeline.keep_one_of_each(spark, kept, str(tmp_path))
    groups = simhash.near_duplicates(kept)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(r["component_id"] for r in groups.select("component_id").distinct().collect())
    mixed = corpus_pipeline.mix_sources(spark, single, str(tmp_path))
    assert mixed.columns == names and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in single.collect()}
    rows = corpus_pipeline.pack_sequences(spark, mixed, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in single.collect()}
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None and language_id and mixing and packing and vocabulary
