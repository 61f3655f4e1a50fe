import functools
import math
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, epoch string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "own") for i, t, s in rows], SCHEMA)


def corpus():
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(400)] + [(1000 + i, "x " * 5, "mid") for i in range(60)] + [(2000 + i, "y " * (3 + i), None) for i in range(12)]
    return rows + [(3000, None, "empty"), (3001, "", "empty"), (3002, "one long " * 5000, "long")]


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    names = ["doc_id", "source", "n_tokens", "epoch", "block", "block_pos", "doc_pos"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({queries.ORACLES['op4_temperature_mixing']})").fetchall(), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in queries.op4_temperature_mixing(spark, sf).collect()), key=repr) == want


def test_plan_is_native(spark):
    plan = mixing.scheduled(docs(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(repetition_limit=4.0), mixing.Target(entropy=0.9), mixing.Target(repetition_limit=1.5, budget=30_000)])
def test_budgets_and_permutations(spark, target):
    rows = corpus()
    tokens = {i: len((t or "").split()) for i, t, _ in rows}
    own = defaultdict(int)
    for i, _, s in rows:
        own[s] += tokens[i]
    totals = mixing.source_totals(mixing.counted(docs(spark, rows)))
    alpha = mixing.exponent(totals, target)
    p = {s: n / sum(own.values()) for s, n in own.items() if n}
    q = {s: x**alpha for s, x in p.items()}
    z = sum(q.values())
    budget = target.budget / z if target.budget else max(own[s] / q[s] for s in q)
    if target.entropy:
        assert -sum(x / z * math.log(x / z) for x in q.values()) <= target.entropy + 1e-6
    elif alpha < 1:
        assert max(q[s] * budget / own[s] for s in q) <= target.repetition_limit + 1e-6
    got = mixing.scheduled(docs(spark, rows), target).collect()
    read = defaultdict(int)
    places = Counter()
    for r in got:
        read[r["source"]] += r["n_tokens"]
        places[r["source"], r["epoch"], r["block"], r["doc_pos"]] += 1
    longest = {s: max(tokens[i] for i, _, t in rows if t == s) for s in own}
    for s in q:
        assert 0 <= read[s] - math.floor(q[s] * budget + 0.5) <= longest[s]
    assert set(places.values()) == {1}
    assert sorted(r["doc_id"] for r in got if r["source"] == "empty") == [3000, 3001]
    by_epoch = Counter((r["doc_id"], r["epoch"]) for r in got)
    assert set(by_epoch.values()) == {1}
    mixed = mixing.mixed(docs(spark, rows), target)
    assert mixed.columns == docs(spark, rows).columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in got)


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(repetition_limit=1.5, budget=30_000)])
def test_mixed_reads_what_is_scheduled(spark, target, monkeypatch):
    """Repeated and null ids, -1 among them: as many copies of each as scheduled, and no document is lost where every source is covered."""
    rows = corpus() + [(None, "no id here", "big"), (None, "none here either", "mid"), (-1, "minus one", "big")] + [(5, "twice", "big")] * 2 + [(1000 + k, "again and again", "mid") for k in range(60)] + [(1001, "x " * 5, "mid")] * 40
    df = docs(spark, rows)
    want = Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in mixing.scheduled(df, target).collect())
    count = lambda found: Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in found.collect())
    assert count(mixing.mixed(df, target)) == want
    if target.budget is None:
        assert set(want) == {(i, s, len((t or "").split())) for i, t, s in rows}
        assert all(want[k] >= n for k, n in Counter((i, s, len((t or "").split())) for i, t, s in rows).items())
    # and the same without any broadcast
    monkeypatch.setattr(mixing, "attached", functools.partial(mixing.attached, limit=-1))
    assert count(mixing.mixed(df, target)) == want


def test_mixed_keeps_columns_of_any_name(spark):
    own = ["k", "doc_id", "_block", "_source", "row", "times", "copy", "m", "n_tokens", "a.b", "text", "origin"]
    rows = [(k, 100 + k, 1, "s", "r", 7, 8, 9, 10, "dot", f"word{k} " * (1 + k % 5), "big" if k % 3 else "small") for k in range(120)]
    found = mixing.mixed(spark.createDataFrame(rows, own), source="origin", key="k")
    assert found.columns == own
    got = Counter(tuple(r) for r in found.collect())
    assert set(got) == set(rows) and set(got.values()) == {1, 2}


def test_nothing(spark):
    empty = docs(spark, [])
    assert mixing.scheduled(empty).count() == 0 and mixing.mixed(empty).count() == 0
    blank = docs(spark, [(1, None, None), (2, " ", "a")])
    assert sorted(r["doc_id"] for r in mixing.mixed(blank).collect()) == [1, 2]
    assert sorted((r["doc_id"], r["source"]) for r in mixing.scheduled(blank).collect()) == [(1, None), (2, "a")]


def test_block_count_is_a_root(spark):
    words = mixing.counted(docs(spark, corpus()))
    row = mixing.budgets(mixing.source_totals(words), mixing.Target()).where("source = 'big'").first()
    assert row["blocks"] == 20 and row["epochs"] == 1
    assert F is not None
