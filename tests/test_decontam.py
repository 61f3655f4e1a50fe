"""The two paths of the n-gram search on rows with two sides."""

import numpy as np

from pyspark.sql import functions as F

from tessella.operators import audit, decontam, quality


def test_join_path_gives_what_the_scan_gives(spark):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(1, words(0, 20), words(100, 400)), (2, words(500, 520), words(5, 25)), (3, words(600, 640), words(700, 720)), (4, words(0, 15), None), (5, "short", words(0, 30)), (6, words(0, 20), words(0, 20)), (6, words(0, 20), words(800, 830))]
    docs = spark.createDataFrame(rows, "id long, target string, retain string")
    bench = spark.createDataFrame([(words(0, 30),)], "text string")
    plain = lambda df: sorted((r["key"], r["side"], r["n_ngrams"], r["hits"]) for r in df.collect())
    scan, join = (plain(decontam.side_hits(docs, bench, "id", ["target", "retain"], limit=n)) for n in (64 << 20, 0))
    assert join == scan and len(scan) == 12
    found = [sorted(map(tuple, decontam.contaminated(docs, {"B": bench}, "id", ["target", "retain"], limit=n).drop("sample_ngrams").collect())) for n in (64 << 20, 0)]
    assert found[0] == found[1]
    one = {r[0]: r for r in found[1]}[1]
    assert one[5] == 8 and one[6] == round(8 / (8 + 288), 6)


def test_benchmarks_in_one_scan_agree_with_one_by_one(spark):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    docs = spark.createDataFrame([(1, words(0, 40), None), (2, words(30, 60), words(0, 14)), (3, words(200, 230), "short"), (2, words(30, 50), None)], "id long, target string, retain string")
    benches = {"A": spark.createDataFrame([(words(0, 30),), (None,)], "text string"), "B": spark.createDataFrame([(words(10, 50),)], "text string"), "C": spark.createDataFrame([(words(900, 950),)], "text string")}
    rows = lambda found: sorted(map(tuple, found.drop("benchmark_order").collect()))
    for limit in (64 << 20, 0):
        together = decontam.contaminated(docs, benches, "id", ["target", "retain"], limit=limit)
        apart = [r for name, bench in benches.items() for r in rows(decontam.contaminated(docs, {name: bench}, "id", ["target", "retain"], limit=limit))]
        assert rows(together) == sorted(apart) and len(apart) == 4
        assert {(r["benchmark"], r["benchmark_order"]) for r in together.collect()} == {("A", 0), ("B", 1)}


def test_bloom_finds_what_was_put_in(spark):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    index = decontam.ngrams(spark.createDataFrame([(0, words(0, 3000))], "k long, text string"), "k", "text", 13).select("ngram").distinct()
    bloom = decontam.Bloom.of(index, 13, 1 << 12)
    hashes = decontam.Hashes()
    assert bloom.may_have(hashes.windows(words(0, 3000).split(), 13)).all()
    others = bloom.may_have(hashes.windows(words(5000, 25000).split(), 13))
    assert 0 < others.mean() < 0.02  # 4,096 words of 64 bits for 2,988 n-grams
    assert decontam.Bloom.of(index.limit(0), 13, 16).table.sum() == 0
    assert not decontam.Bloom(np.zeros(16, dtype=np.uint64)).may_have(np.arange(5, dtype=np.uint64)).any()


def test_only_hits_and_false_positives_are_looked_up(spark, monkeypatch):
    """A full filter lets everything through, a sparse one next to nothing; the rows are the same."""
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    docs = spark.createDataFrame([(k, words(100 * k, 100 * k + 90), None) for k in range(40)] + [(900, words(0, 40), words(350, 380))] * 3, "id long, target string, retain string")
    bench = spark.createDataFrame([(words(0, 400),)], "text string")
    looked_up = []
    real = decontam.joined
    monkeypatch.setattr(decontam, "joined", lambda rows, *rest: looked_up.append(rows.count()) or real(rows, *rest))
    plain = lambda df: sorted((r["key"], r["side"], r["n_ngrams"], r["hits"]) for r in df.collect())
    scan = plain(decontam.side_hits(docs, bench, "id", ["target", "retain"]))
    hits = sum(len(r[3]) for r in scan)
    for size in (1, 1 << 20):
        assert plain(decontam.side_hits(docs, bench, "id", ["target", "retain"], limit=0, bloom_words=size)) == scan
    assert looked_up[0] > 2 * hits and looked_up[1] == hits


def test_audit_in_one_pass_is_the_audit_by_parts(spark):
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(1, "x", words(0, 80), words(100, 200)), (2, "x", words(0, 80).upper(), "漢字 " + words(300, 400)), (3, "y", " \n\t\u3000", words(0, 90)), (4, "y", None, None), (5, None, "short", words(0, 90))]
    rows += [(6, "y", words(500, 600), words(10, 30) + " " + words(700, 800)), (7, "x", "\\textbf " + words(0, 80), words(800, 900)), (8, "y", "ﬁ" + words(0, 80), words(0, 80)), (8, "y", "twice " + words(0, 80), words(0, 80))]
    docs = spark.createDataFrame(rows, "id long, g string, target string, retain string")
    bench = spark.createDataFrame([(words(5, 25),)], "text string")
    flagged = quality.flags(docs)
    hits = decontam.side_hits(docs, bench, "id", ["target", "retain"]).where(F.size("hits") > 0).select(F.col("key").alias("id"), F.lit(True).alias("hit")).distinct()
    dups = quality.duplicates(docs, "target", "id").select("id", "is_duplicate").distinct()
    parts = flagged.join(hits, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).join(dups, "id")
    want = sorted(map(tuple, quality.audit(parts, ["g"], "hit").collect()), key=str)
    for limit in (64 << 20, 0):
        assert sorted(map(tuple, audit.audited(docs, bench, "id", ["g"], ["target", "retain"], limit=limit).collect()), key=str) == want
    assert audit.audited(docs.limit(0), bench, "id", ["g"], ["target"]).count() == 0
