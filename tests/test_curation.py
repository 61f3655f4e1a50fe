"""Curation queries over whole texts."""

from tessella.operators import gates
from tessella.plans.curation import cjk_repaired_whole, gate_reasons


def test_gates_see_the_whole_retain_side(spark, tmp_path):
    pad = "plain words that say nothing much " * 52
    texts = [f"{pad} it lies on top of the box", f"near the door {pad}", pad, f"12 = 3 {pad}", f"7 {pad}"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["corpus"], r["reason"]): r["n"] for r in gate_reasons(spark, str(tmp_path)).collect()}
    pairs = spark.createDataFrame(list(zip(texts, [*texts[1:], ""], strict=True)), "target string, retain string")
    want = {}
    for corpus in ("spl_cc", "stp_cc", "ctr_cc", "core_math", "null_cc", "tom_cc"):
        for r in gates.validate(pairs, corpus).collect():
            key = corpus, (r["reason"] or "pass").split(" \'")[0]
            want[key] = want.get(key, 0) + 1
    assert got == want
    assert any(c == "spl_cc" and "retain" in r and "digit" in r for c, r in got), got


def test_cjk_repair_beyond_the_first_characters(spark, tmp_path):
    texts = ["x" * 500 + "１２、漢字。" + "y" * 500 + "호텔", "plain"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["repaired"] for r in cjk_repaired_whole(spark, str(tmp_path)).collect()}
    assert got == {0: "AB1,.hotel“ok”" + "x" * 500 + "12,." + "y" * 500 + "hotel", 1: "AB1,.hotel“ok”plain"}
