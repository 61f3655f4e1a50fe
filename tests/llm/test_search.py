"""MaxScore against brute force; the forest's answers and recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import hash_forest, maxscore

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def usable(v, zero):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def brute_inner(rows, queries, k):
    rows = [(i, v) for i, v in rows if i is not None and usable(v, True)]
    out = {}
    for q, qv in rows:
        if q % queries == 0:
            scored = []
            for i, v in rows:
                if i != q:
                    scored.append((-sum(int(np.floor(256 * float(np.float32(a)))) * int(np.floor(256 * float(np.float32(b)))) for a, b in zip(qv, v)), i))
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def odd_rows():
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # ties
    return rows + [(401, None), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7), (405, [0.0] * 8), (None, [1.0] * 8), (406, [2.0, 3.0]), (450, [])]


@pytest.mark.parametrize("chunk", [7, 2048])
def test_maxscore_is_exact(spark, monkeypatch, chunk):
    rows = odd_rows()
    assert found(maxscore.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0)) == {q: v for q, v in brute_inner(rows, 10, 5).items() if v}
    if chunk == 7:  # the traversal itself, in small chunks so that thresholds rise
        clean = [(i, v) for i, v in rows if i is not None and usable(v, True) and len(v) == 8]
        monkeypatch.setattr(maxscore, "CHUNK", chunk)
        shard = maxscore.Shard(np.array([i for i, _ in clean]), maxscore.quantised(np.array([v for _, v in clean])))
        expected = brute_inner(clean, 10, 5)
        for i, v in clean:
            if i % 10 == 0:
                ids, scores = shard.top(i, maxscore.quantised(np.array(v)), 5)
                assert list(zip(ids.tolist(), map(int, scores))) == expected[i]


def test_maxscore_sparse_terms_skip_rows():
    rng = np.random.default_rng(3)
    weights = np.where(rng.random((5000, 40)) < 0.05, rng.integers(1, 200, (5000, 40)), 0).astype(float)
    shard = maxscore.Shard(np.arange(5000), weights)
    for q in range(20):
        ids, scores = shard.top(q, weights[q], 5)
        all_ = weights @ weights[q]
        all_[q] = -1
        best = np.lexsort((np.arange(5000), -all_))[:5]
        assert ids.tolist() == best.tolist() and scores.tolist() == all_[best].tolist()
    assert shard.scored < 0.75 * 20 * 5000  # the others are in no essential posting


def test_a_shard_is_indexed_once(spark, monkeypatch):
    """Whatever the number of queries and of Arrow batches; its queries stream past."""
    from tessella.llm import vector_grid

    monkeypatch.setattr(vector_grid, "LEAST_ROWS", 100)
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), 0) for i in range(1000)], SCHEMA)
    built, answered = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Counted(hash_forest.Index):
        def __init__(self, ids, v):
            built.add(1)
            super().__init__(ids, v, 3)

        def answers(self, query_ids, asked):
            answered.add(len(query_ids))
            return super().answers(query_ids, asked)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = vector_grid.search(vector_grid.usable(rows, "vec_id", "embedding", False), F.col("vec_id") % 2 == 0, 3, True, "double", Counted).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1500 and answered.value == 500 * 10 and built.value == 10


def test_clashing_columns_and_repeated_queries(spark):
    """Further columns take no part; of a repeated query id the least vector asks; a longer vector is one like any other."""
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0] + [0.0] * 300 + [5.0])]
    clean = frame(spark, rows)
    clash = clean
    for c in ("shard", "asks", "v", "cell", "o", "query_id", "score", "rank"):
        clash = clash.withColumn(c, F.lit("x"))
    for search in (maxscore.top_k, hash_forest.nearest):
        one, two = (found(search(df, F.col("vec_id") == 0)) for df in (clean, clash))
        assert one == two
    assert found(maxscore.top_k(clash, F.col("vec_id") == 0)) == {0: [(2, 65536), (1, 0), (3, -65536)]}
    near = found(hash_forest.nearest(clash, F.col("vec_id") == 0))[0]
    assert [i for i, _ in near] == [2, 1, 3] and near[0][1] == 1.0


def test_maxscore_large_weights(spark):
    rows = [(0, [3e38, 1.0]), (1, [-3e38, 1.0]), (2, [1e30, 5.0]), (3, [0.0, 1.0])]
    got = found(maxscore.top_k(frame(spark, rows), F.col("vec_id") == 0))
    assert [i for i, _ in got[0]] == [2, 3, 1] and got[0][0][1] == 2**63 - 1 and got[0][2][1] == -(2**63)


def test_search_of_nothing(spark):
    empty = frame(spark, [])
    assert maxscore.top_k(empty, F.col("vec_id") % 2 == 0).count() == 0
    assert hash_forest.nearest(empty, F.col("vec_id") % 2 == 0).count() == 0
    one = frame(spark, [(0, [1.0, 2.0])])
    assert maxscore.top_k(one, F.col("vec_id") % 2 == 0).count() == 0
    assert hash_forest.nearest(one, F.col("vec_id") % 2 == 0).count() == 0


def test_forest_distances_ties_and_missing(spark):
    rows = odd_rows()
    got = found(hash_forest.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0))
    clean = {i: np.array(list(np.float32(v)) + [0.0] * (8 - len(v)), dtype=float) for i, v in rows if i is not None and usable(v, False)}
    assert set(got) == {i for i in clean if i % 50 == 0} and 405 not in {i for v in got.values() for i, _ in v}
    for q, answer in got.items():
        assert len(answer) == 10 and q not in [i for i, _ in answer]
        assert answer == sorted(answer, key=lambda x: (x[1], x[0]))
        for i, s in answer:
            assert s == pytest.approx(np.sqrt(((clean[i] - clean[q]) ** 2).sum()), rel=1e-12)


def test_forest_recall(spark):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    got = found(hash_forest.nearest(rows, F.col("vec_id") % 100 == 0))
    v = v.astype(np.float32).astype(float)
    hits = 0
    for q, answer in got.items():
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {i for i, _ in answer})
    assert len(got) == 60 and hits / 600 >= 0.9


def test_longest_prefix_ranges():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((500, 16))
    forest = hash_forest.Forest(v)
    strings = forest.strings(v[:3])
    all_ = forest.strings(v)
    for s in strings:
        for wanted in (1, 20, 200, 500):
            got = set(forest.candidates(s, wanted).tolist())
            shared = np.array([[hash_forest.BITS - int(a ^ b).bit_length() for a, b in zip(row, s)] for row in all_]).max(axis=1)
            depth = max(d for d in range(hash_forest.BITS + 1) if (shared >= d).sum() >= wanted)
            assert got == set(np.flatnonzero(shared >= depth).tolist())
