"""Selections against plain versions, and the merge of result trees with what it passes over."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import selection
from tessella.sources.sinks import Versioned


def test_merging_a_tree_loses_nothing(spark, tmp_path):
    def put(folder, name, payload):
        path = tmp_path / folder
        path.mkdir(exist_ok=True)
        (path / name).write_text(payload if isinstance(payload, str) else json.dumps(payload, indent=1))

    result = lambda at, ca: {"timestamp": at, "contrastive_accuracy": ca, "per_category": {"x": {"n": 1}}}
    put("one", "m1.json", {"model": "m1", "results": {"tom": result("2024-01-02", 0.5), "mor": result("2024-01-02", 0.4)}})
    put("one", "m2.json", {"results": {"tom": result("2024-01-01", 0.1)}})
    table = Versioned(spark, f"{tmp_path}/table")
    assert {r["model"]: r["corpora"] for r in selection.merge_tree(spark, f"{tmp_path}/one", table).collect()} == {"m1": ["mor", "tom"], "m2": ["tom"]}
    # a partial and partly older document, and files that are passed over
    put("two", "m1.json", {"model": "m1", "results": {"tom": result("2024-01-01", 0.9), "str": result("2024-01-03", 0.7)}})
    put("two", "m3.json", {"model": "", "results": {"tom": result("2024-01-01", 0.3)}})
    put("two", "m2.json", "{broken")
    put("two", "m5.json", "[1, 2]")
    put("two", "m6.json", {"model": "m6"})
    put("two", "percategory_m1.json", {"model": "m1", "results": {"bad": result("2030-01-01", 0)}})
    put("two", "table5.json", {"model": "m1", "results": {"bad": result("2030-01-01", 0)}})
    put("two", "notes.txt", "no json")
    assert {r["model"]: r["corpora"] for r in selection.merge_tree(spark, f"{tmp_path}/two", table).collect()} == {"m1": ["mor", "str", "tom"], "m3": ["tom"]}
    found = {(r["model"], r["corpus"]): json.loads(r["result"])["contrastive_accuracy"] for r in table.read().collect()}
    assert found == {("m1", "tom"): 0.5, ("m1", "mor"): 0.4, ("m1", "str"): 0.7, ("m2", "tom"): 0.1, ("m3", "tom"): 0.3}


def test_models_and_representatives(spark):
    table = spark.createDataFrame([("a", 7.0, "x"), ("b", 70.0, "x"), ("c", 1.0, "y")], "model string, size_b double, hardware string")
    names = lambda df: sorted(r["model"] for r in df.collect())
    assert names(selection.models(table)) == ["a", "b", "c"] and names(selection.models(table, hardware="x", most_params=10)) == ["a"]
    assert names(selection.models(table, ["b", "c"], hardware="x")) == ["b", "c"]  # an explicit list is all there is
    with pytest.raises(ValueError, match="d, z"):
        selection.models(table, ["z", "a", "d"])
    wide = spark.createDataFrame([("a", 1.0, None, 3.0), ("b", 1.0, 1.0, 0.5), ("c", None, None, 9.0), ("d", 2.0, 2.0, None)], "model string, s double, t double, avg double")
    pick = lambda preferred, **more: [r["model"] for r in selection.representatives(wide, "model", ["s", "t"], "avg", preferred, **more).collect()]
    assert sorted(pick(["a", "c", "x"], least=2)) == ["a", "c"] and pick(["a", "x"], least=2, first=3) == ["b", "d", "a"]


def test_examples_and_pairs(spark):
    seeds = spark.createDataFrame([(1, "x", "easy"), (2, "x", None), (3, "y", "hard")], "id int, category string, difficulty string")
    examples = spark.createDataFrame([("x", "easy", 2, "b"), ("x", "easy", 1, "a"), ("x", None, 1, "n")], "category string, difficulty string, k int, text string")
    found = {r["id"]: [e["text"] for e in r["examples"]] for r in selection.with_examples(seeds, examples, ["category", "difficulty"], "k", ["text"]).collect()}
    assert found == {1: ["a", "b"], 2: ["n"], 3: []}
    row = spark.createDataFrame([("a", "b", "b", "a"), ("a", "b", "a", "a"), ("a", None, None, "a")], "a string, b string, c string, d string")
    assert [r["s"] for r in row.select(selection.same_pair(*map(F.col, "abcd")).alias("s")).collect()] == [True, False, False]
    kept = selection.mapped(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "m string, v int"), spark.createDataFrame([("a", 5.0), ("b", None)], "m string, w double"), "m")
    assert [tuple(r) for r in kept.collect()] == [("a", 1, 5.0)]


def test_questions_stay_together(spark):
    answers = spark.createDataFrame([(k, f"q{k % 7}") for k in range(300)], "id int, q string").repartition(5)
    found = selection.by_question(answers, "q", ["a", "b"], parts=4).withColumn("part", F.spark_partition_id())
    rows = found.collect()
    assert len(rows) == 600
    for part in {r["part"] for r in rows}:
        order = [(r["judge"], r["q"]) for r in rows if r["part"] == part]
        assert order == sorted(order)


def test_quick_accuracy(spark):
    rows = [("m", "t", "r", True, False), ("m", "t", "r", None, True), ("m", "", "r", True, True), ("m", "t", None, True, True), ("m", " ", "r", True, None), ("n", "", "", True, True)]
    got = selection.quick_accuracy(spark.createDataFrame(rows, "g string, target string, retain string, target_ok boolean, retain_ok boolean"), ["g"]).collect()
    assert [tuple(r) for r in got] == [("m", 3, 0.6667, 0.3333, 0.3333)]
