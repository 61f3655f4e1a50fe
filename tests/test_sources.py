"""Sources and sinks on files of their own."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import registry, scans, sinks


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows))


@pytest.fixture
def root(tmp_path):
    lines(tmp_path / "train/tom_cc_train.jsonl", [{"scenario_id": f"s{k}", "category": "a", "difficulty": "easy", "target": f"t{k}", "retain": "é 你"} for k in range(5)] + ["", "   ", "{broken"])
    lines(tmp_path / "holdout/tom_cc_holdout.jsonl", [{"scenario_id": "h", "target": "x", "retain": "y"}])
    lines(tmp_path / "bench/ctr_cc_bench.jsonl", [{"scenario_id": 7, "domain": "d", "target_text": "T", "retain_text": "R", "timestamp": "2024-01-02T03:04:05"}])
    lines(tmp_path / "coin/Cyber/cyber_coin_bench.jsonl", [{"id": "c", "theme": "th", "target": "a", "retain": "b"}] * 2)
    return str(tmp_path)


def test_places(root):
    assert registry.place(root, "tom_cc", "train").endswith("/train/tom_cc_train.jsonl") and registry.place(root + "/", "legal", "bench").endswith("/coin/Legal/legal_coin_bench.jsonl")
    for corpus, split in (("coin", "bench"), ("nothing", "train"), ("tom_cc", "test")):
        with pytest.raises(ValueError):
            registry.place(root, corpus, split)


def test_corpora(spark, root):
    rows = scans.corpus(spark, root, "tom_cc", "train").collect()
    assert sorted(r["target"] for r in rows) == [f"t{k}" for k in range(5)] and {r["retain"] for r in rows} == {"é 你"}  # blank and broken lines are none
    assert scans.corpus(spark, root, "tom_cc", "train", limit=2).count() == 2
    both = scans.corpus(spark, root, "tom_cc", "bench")  # train and holdout, as there is no bench file
    assert both.count() == 6 and {r["category"] for r in both.where("scenario_key = 'h'").collect()} == {"unknown"}
    one = scans.corpus(spark, root, "ctr_cc", "bench").first()
    assert (one["target"], one["retain"], one["domain"], str(one["timestamp"]), one["difficulty"]) == ("T", "R", "d", "2024-01-02 03:04:05", "all")
    assert [(r["corpus"], r["split"], r["n"]) for r in scans.catalog(spark, root).collect()] == [("tom_cc", "holdout", 1), ("tom_cc", "train", 6), ("ctr_cc", "bench", 1), ("cyber", "bench", 2)]
    assert {r["corpus"] for r in registry.corpora(spark).where("coin").collect()} == set(registry.COIN)


def test_json_lines(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"id": 1, "k": "x"}, {"id": 2}, "nonsense", "", {"id": 3, "k": "z"}])
    path = f"{tmp_path}/a.jsonl"
    assert scans.json_lines(spark, path, "id long, k string").count() == 3
    assert scans.json_lines(spark, path, "id long, k string", "keep").where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.json_lines(spark, path, "id long, k string", "raise").collect()
    assert [r["k"] for r in scans.one_key(spark, path, "k").collect()] == ["x", "z"] and scans.one_key(spark, path, "k", 2).count() == 1
    lines(tmp_path / "b.jsonl", [{"id": 9}])
    assert scans.json_lines(spark, [path, f"{tmp_path}/b.jsonl"], "id long").count() == 4
    assert scans.first_source(spark, f"{tmp_path}/none", path) == path and scans.first_source(spark, f"{tmp_path}/none") is None


def test_result_trees(spark, tmp_path):
    cell = {"corpus": "tom_cc", "primitive": "ToM", "status": "ok", "acc_target": 0.9, "acc_retain": 0.5, "contrastive_accuracy": 0.4}
    model = {"model": "m", "size_b": 7.0, "family": "f", "arch": "dense", "tier": "7-9B", "results": {"tom_cc": cell, "mor_cc": cell | {"status": "failed"}, "spl": {k: v for k, v in cell.items() if k not in ("corpus", "contrastive_accuracy")}, "x": {k: v for k, v in cell.items() if k != "corpus"}}}
    (tmp_path / "m.json").write_text(json.dumps(model))
    (tmp_path / "percategory_m.json").write_text(json.dumps(model))
    (tmp_path / "bad.json").write_text("{")
    rows = scans.result_tree(spark, f"{tmp_path}/*.json").collect()
    assert sorted((r["corpus"], r["ca"]) for r in rows) == [("tom_cc", 0.4), ("x", 0.4)] and rows[0]["log_params"] == pytest.approx(9.845098)
    held = spark.createDataFrame([('{"a":{"acc":0,"f1":0.25}}',), ('{"a":{"acc":0.5}}',), ("{}",)], "d string").select(scans.nested_metric(F.col("d"), "$.a.acc", "$.a.f1").alias("m"))
    assert [r["m"] for r in held.collect()] == [0.25, 0.5, None]


def test_lm_eval_tree(spark, tmp_path):
    tree = {"results": {"mmlu": {"acc,none": 0.5, "alias": "mmlu"}, "mmlu_law": {"acc,none": "0.25", "acc_norm,none": 0.75, "x": "n/a"}}}
    lines(tmp_path / "deep/er/results_1.json", [tree])
    lines(tmp_path / "deep/other.json", [tree])
    rows = scans.lm_eval_tree(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("mmlu", "acc", 0.5), ("mmlu_law", "acc", 0.25), ("mmlu_law", "acc_norm", 0.75)]
    assert tuple(scans.aggregate_task(rows.withColumn("b", F.lit("mmlu")), "b").first()) == ("mmlu", "mmlu", 2)
    first = rows.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m")).select("task", scans.first_metric(F.col("m")).alias("v"))
    assert {r["task"]: r["v"] for r in first.collect()} == {"mmlu": 0.5, "mmlu_law": 0.75}


def test_csv_matrix_and_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Model,a,b\n Big One ,1.5,n/a\nsmall,NaN,2\n")
    rows = scans.csv_matrix(spark, f"{tmp_path}/m.csv", "Model").orderBy("join_key").collect()
    assert [(r["join_key"], r["a"], r["b"]) for r in rows] == [("big one", 1.5, None), ("small", None, 2.0)]
    data = (tmp_path / "m.csv").read_bytes()
    one = scans.checksums(spark, f"{tmp_path}/m.csv").first()
    assert (one["bytes"], one["sha256"], one["md5"]) == (len(data), hashlib.sha256(data).hexdigest(), hashlib.md5(data).hexdigest())
    assert scans.line_counts(spark, f"{tmp_path}/m.csv").first()["lines"] == 3


def test_metadata(spark, root):
    found = scans.metadata(spark, root)
    assert {d["name"] for d in found["distribution"]} == {"tom_cc_train.jsonl", "tom_cc_holdout.jsonl", "ctr_cc_bench.jsonl", "cyber_coin_bench.jsonl"}
    assert {r["name"] for r in found["recordSet"]} == {"tom_cc_train", "tom_cc_holdout", "ctr_cc_bench", "cyber_bench"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "é 你"), (2, None)], "id long, t string")
    path = f"{tmp_path}/out"
    for _ in range(2):
        sinks.json_overwrite(df, path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert sorted(text.split("\n"))[1:] == ['{"id":1,"t":"é 你"}', '{"id":2}']
    assert [sinks.append_new(df, f"{tmp_path}/app", ["id"], spark) for _ in range(2)] == [2, 0]
    assert sinks.append_new(spark.createDataFrame([(2, "again"), (3, "new")], df.schema), f"{tmp_path}/app", ["id"], spark) == 1
    sinks.routed(df, f"{tmp_path}/routed", F.col("id") == 1)
    assert {(r["id"], r["split"]) for r in spark.read.parquet(f"{tmp_path}/routed").collect()} == {(1, "holdout"), (2, "train")}
    assert sinks.filtered_copy(df, spark.createDataFrame([(2,), (9,)], "id long"), "id", f"{tmp_path}/kept") == (1, 1)
    cells = spark.createDataFrame([("m", "a", 1), ("m", "b", 2)], "model string, corpus string, v int")
    sinks.partitions_overwrite(cells, f"{tmp_path}/cells", ["model", "corpus"])
    sinks.partitions_overwrite(cells.where("v = 1").withColumn("v", F.lit(9)), f"{tmp_path}/cells", ["model", "corpus"])
    assert sorted((r["corpus"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/cells").collect()) == [("a", 9), ("b", 2)]
    result = spark.createDataFrame([("m", "t", "0.5", 10, 1, "e", "d", "extra")], "model string, task string, accuracy string, n_samples int, seed int, experiment string, driver_path string, more string")
    sinks.append_results(result, f"{tmp_path}/results")
    sinks.append_results(result, f"{tmp_path}/results")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/results").collect()] == [("m", "t", 0.5, 10, 1, "e", "d")] * 2


def test_versioned_table(spark, tmp_path):
    table = sinks.Versioned(spark, f"{tmp_path}/v")
    assert table.read() is None
    row = lambda k, v, at: (k, v, at)
    table.upsert(spark.createDataFrame([row("a", 1, "2024-01-01"), row("b", 1, "2024-01-01")], "k string, v int, at string"), ["k"], "at")
    found = table.upsert(spark.createDataFrame([row("a", 2, "2024-01-02"), row("b", 0, "2023-01-01"), row("c", 3, "2024-01-01")], "k string, v int, at string"), ["k"], "at")
    assert sorted((r["k"], r["v"]) for r in found.collect()) == [("a", 2), ("b", 1), ("c", 3)]
    (tmp_path / "v/data-half").mkdir()  # a version that no pointer names
    assert table.rewrite(lambda df: df.withColumn("v", F.col("v") + 1), "k", dry_run=True) == {"rows": 3, "changed": 3, "written": False}
    assert table.rewrite(lambda df: df.withColumn("v", F.col("v") + 1), "k")["written"] and sorted(r["v"] for r in table.read().collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        table.rewrite(lambda df: df.where("k <> 'a'"), "k")
    assert not table.rewrite(lambda df: df, "k")["written"]


def test_reports(spark):
    rows = spark.createDataFrame([("a|b", 0.12345), (None, None)], "name string, v double")
    assert sinks.table_text(rows).split("\n")[2:] == ["| a\\|b | 0.123 |", "|  |  |"]
    assert sinks.table_text(rows, "latex").startswith("\\begin{tabular}{ll}") and json.loads(sinks.table_text(rows, "json"))[0]["v"] == 0.12345
    with pytest.raises(ValueError):
        sinks.table_text(rows, most=1)
    merged = sinks.merge_report(spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("y", 3), ("z", 4)], "k string, v int"), "k")
    assert sorted(map(tuple, merged.collect())) == [("x", 1), ("y", 3), ("z", 4)]


def test_two_writers_of_one_version(spark, tmp_path):
    """The second writer finds the number taken, merges again and loses nothing."""
    table = sinks.Versioned(spark, f"{tmp_path}/table")
    rows = lambda *some: spark.createDataFrame(list(some), "k int, v string, at string")
    table.write(rows((1, "a", "1")))
    merged = []

    def make(old):
        if not merged:  # another writer comes in between
            sinks.Versioned(spark, f"{tmp_path}/table").upsert(rows((2, "b", "1")), ["k"], "at")
        merged.append(sorted(r["k"] for r in old.collect()))
        return old.unionByName(rows((3, "c", "1")))

    table.change(make)
    assert merged == [[1], [1, 2]]
    assert sorted(r["k"] for r in table.read().collect()) == [1, 2, 3]
    assert table.latest()[0] == 2 and not table.publish(2, "elsewhere")


def test_put_once_by_many(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: sinks.put_once(spark, f"{tmp_path}/p/one", str(k)), range(24)))
    assert sum(won) == 1 and (tmp_path / "p/one").read_text() == str(won.index(True))
    assert [p.name for p in (tmp_path / "p").iterdir() if not p.name.endswith(".crc")] == ["one"]
