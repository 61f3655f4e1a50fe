"""The grading queue and leases as streams, with restarts."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.functions import graders
from tessella.sources.sinks import Versioned
from tessella.streaming import leases, queue


def answers(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def answer(pair, text, at, **more):
    return {"model": "m", "corpus": "spl_cc", "pair_id": pair, "side": "target", "answer": text, "reference": "it is 4", "category": "c", "difficulty": "d", "timestamp": at} | more


def test_queue_survives_a_restart(spark, tmp_path):
    results, pending = Versioned(spark, f"{tmp_path}/results"), tmp_path / "pending"
    grade = lambda df: df.withColumn("ok", graders.auto_number(F.col("answer"), F.col("reference")))

    def run():
        query = queue.grade_into(queue.pending(spark, str(pending)), results, f"{tmp_path}/failed", grade, ["pair_id", "side"], f"{tmp_path}/checkpoint")
        query.awaitTermination(120)
        return {r["pair_id"]: r["ok"] for r in results.read().collect()}

    answers(pending, "a.json", [answer("1", "4", "2024-01-01"), answer("2", "5", "2024-01-01"), "{broken", answer("9", "4", "2024-01-01", model=None)])
    assert run() == {"1": True, "2": False}
    assert spark.read.option("basePath", f"{tmp_path}/failed").json(f"{tmp_path}/failed").count() == 2
    answers(pending, "b.json", [answer("2", "4", "2024-01-02"), answer("1", "7", "2023-01-01"), answer("3", "4", "2024-01-01")])
    assert run() == {"1": True, "2": True, "3": True}  # the later answer wins, the older one is passed over, files are read once
    folder = results.current()
    assert run() == {"1": True, "2": True, "3": True} and results.current() == folder


def test_keys_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = datetime(2024, 1, 1)
    rows = [{"k": k, "at": (at + timedelta(minutes=m)).isoformat()} for k, m in (("a", 0), ("a", 1), ("b", 2), ("a", 3), ("late", 600))]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = lambda: spark.readStream.schema("k string, at timestamp").json(f"{tmp_path}/in")
    out = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    out(queue.new_keys(stream(), ["k"], "at", "1 hour"), "keys", "append")
    assert sorted(r["k"] for r in spark.table("keys").collect()) == ["a", "b", "late"]
    out(queue.windowed_counts(stream(), "at", "10 minutes", "5 minutes", ["k"]), "windows", "append")
    assert {(r["k"], r["n"]) for r in spark.table("windows").collect()} >= {("a", 3), ("b", 1)}


def test_leases_go_stale(spark, tmp_path):
    at = datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    events = [("x", "one", 0), ("x", "two", 30), ("x", "one", 60), ("x", "two", 170), ("x", "two", 200), ("y", "two", 5)]
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"item": i, "node": n, "at": (at + timedelta(minutes=m)).isoformat()}) for i, n, m in events))

    def run(name):
        stream = spark.readStream.schema("item string, node string, at timestamp").json(f"{tmp_path}/in")
        query = leases.grants(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r["item"], int((r["at"] - at).total_seconds()) // 60, r["node"], r["granted"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [("x", 0, "one", True), ("x", 30, "two", False), ("x", 60, "one", True), ("x", 170, "two", False), ("x", 200, "two", True), ("y", 5, "two", True)]
    assert run("a") == first
    # after a restart the holder is remembered
    (tmp_path / "in/b.json").write_text(json.dumps({"item": "x", "node": "one", "at": (at + timedelta(minutes=210)).isoformat()}))
    assert run("b") == sorted([*first, ("x", 210, "one", False)])
    now = F.lit(at + timedelta(minutes=300))
    held = spark.createDataFrame([(i, n, at + timedelta(minutes=m)) for i, n, m in events], "item string, node string, at timestamp")
    assert {(r["item"], r["node"], r["stale"]) for r in leases.current_leases(held, now).collect()} == {("x", "two", False), ("y", "two", True)}
    assert {(r["item"], r["n"]) for r in leases.sessions(held, "item", "at", 100).collect()} == {("x", 3), ("x", 2), ("y", 1)}


def test_a_silent_holder_loses_its_lease(spark, tmp_path):
    """Timers fire without any further event of the item, also when the query has been restarted in between."""
    import time

    spark.conf.set(*leases.STORE)
    (tmp_path / "in").mkdir()
    at = datetime(2024, 1, 1)
    count = iter(range(100))

    def send(*events):
        rows = [json.dumps({"item": i, "node": n, "kind": k, "at": (at + timedelta(seconds=next(count))).isoformat()}) for i, n, k in events]
        (tmp_path / f"in/{next(count):03d}.json").write_text("\n".join(rows))

    def start(seconds):
        stream = spark.readStream.schema("item string, node string, kind string, at timestamp").json(f"{tmp_path}/in")
        writer = leases.lease_events(stream, seconds).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
        return writer.outputMode("append").trigger(processingTime="300 milliseconds").start()

    def seen(item):
        rows = spark.read.schema(leases.EVENTS).parquet(f"{tmp_path}/out").where(F.col("item") == item).collect()
        return [(r["node"], r["event"]) for r in sorted(rows, key=lambda r: (r["at"].year > 2024, r["at"]))]

    def until(done, most=60):
        ends = time.time() + most
        while not done():
            assert time.time() < ends, (seen("x"), seen("y"))
            time.sleep(0.3)

    send(("x", "one", "claim"), ("x", "two", "claim"), ("x", "two", "heartbeat"), ("x", "one", "heartbeat"), ("y", "two", "claim"), ("y", "two", "release"), ("y", "one", "claim"), ("y", "one", "release"), (None, "one", "claim"))
    query = start(20)
    until(lambda: (tmp_path / "out/_spark_metadata/0").exists() and len(seen("x")) == 4)
    query.stop()
    assert seen("x") == [("one", "granted"), ("two", "refused"), ("two", "refused"), ("one", "renewed")]
    assert seen("y") == [("two", "granted"), ("two", "released"), ("one", "granted"), ("one", "released")]
    # the holder of x is silent; nothing is sent for x while the query is down and up again
    query = start(20)
    send(("z", "one", "claim"))
    until(lambda: seen("x")[-1] == ("one", "expired"))
    send(("x", "two", "claim"))
    until(lambda: len(seen("x")) == 6)
    query.stop()
    assert ("two", "granted") in seen("x") and all(event != "expired" for _, event in seen("y"))


def test_lease_decisions():
    assert [leases.decided(h, "a", k) for h in (None, "a", "b") for k in ("claim", "heartbeat", "release", "other")] == [
        "granted", "refused", "refused", "refused", "renewed", "renewed", "released", "refused", "refused", "refused", "refused", "refused",
    ]
