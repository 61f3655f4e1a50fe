"""Quality rules against a plain version; the sketches' bounds and merging."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import quality_rules as quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), len(lines)


def rounded(v):
    cut = max(v.bit_length() - 6, 0)
    return v >> cut << cut


def brute(rows, least_docs):
    counted = [(r[0], r[2:4], counts(r[1])) for r in rows]
    value = {"mean_word": lambda c: 1000 * c[1] // c[0], "symbols": lambda c: 1000 * c[2] // c[1], "dup_lines": lambda c: 1000 * c[3] // c[5]}

    def quartiles(group, name):
        some = sorted(rounded(value[name](c)) for _, g, c in counted if c[0] and g[: len(group)] == group)
        return len(some), some[(len(some) - 1) // 4], some[3 * (len(some) - 1) // 4]

    out = []
    for doc_id, group, c in counted:
        base = c[0] < 10 or 100 * c[4] > 20 * c[0]
        kept = not base
        for rule in quality.RULES if kept else ():
            for depth in (2, 1, 0):
                n, q1, q3 = quartiles(group[:depth], rule.name)
                if n >= least_docs:
                    break
            away = max(rule.steps * (q3 - q1), rule.least)
            v = value[rule.name](c)
            kept &= v <= q3 + away and (not rule.lower or v >= q1 - away)
        out.append((doc_id, *c[:5], base, kept))
    return sorted(out, key=str)


def some_rows():
    rows = []
    for i in range(120):
        words = " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(20 + i % 30))
        rows.append((i, words, ("en", "de")[i % 2], f"s{i % 3}"))
    rows += [(200, None, "en", "s0"), (201, "", "en", "s0"), (202, " \n\t ", "en", None), (203, "one two", None, None)]
    rows += [(210, " ".join(f"w{k}***" for k in range(40)), "en", "s0"), (211, " | ".join(f"cell{k}" for k in range(40)), "de", "s1")]
    rows += [(212, " ".join("abcdefghijklmnopqrstuvwxyz" + str(k) for k in range(40)), "en", "s1"), (213, "a b c d e f g " * 20, "en", "s1")]
    rows += [(214, "\n".join(["same line"] * 8 + [f"x{k} y{k}" for k in range(4)]), "en", "s2"), (215, "é ü straße " * 3 + " ".join(f"ö{k}" for k in range(12)), None, "s9")]
    rows += [(216, "\x0bvertical\x0ctabs\r\nand 1 2 3 4 5 6 7 8\n\n\nlines", "fr", None), (3, rows[3][1], "de", "s0"), (217, " ".join(f"w{k}" for k in range(100_000)), "en", "s0")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("least_docs", [1, 15, 70, 10_000])
def test_verdicts(spark, least_docs):
    rows = some_rows()
    got = quality.verdicts(frame(spark, rows), least_docs=least_docs)
    got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, least_docs)


def test_bad_goes_and_clean_stays(spark):
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(frame(spark, some_rows())).collect()}
    assert not any(kept[i] for i in (200, 201, 202, 203, 210, 211, 212, 213, 214))
    assert all(kept[i] for i in range(120)) and kept[217]


def test_kept_documents_are_the_rows_that_are_kept(spark):
    docs = frame(spark, some_rows())
    for c in ("n_words", "kept", "rule", "bucket", "docs", "hi_symbols", "_row", "a.b"):
        docs = docs.withColumn(c, F.lit(-1))
    got = quality.kept_documents(docs)
    assert got.columns == docs.columns
    kept = sorted(r["doc_id"] for r in quality.verdicts(docs).where("kept").collect())
    assert sorted(r["doc_id"] for r in got.collect()) == kept and len(kept) > 100
    assert {r["n_words"] for r in got.collect()} == {-1}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert quality.verdicts(empty).count() == 0 and quality.kept_documents(empty).count() == 0
    blank = frame(spark, [(1, None, "en", "s"), (2, "", None, None)])
    assert [(r["base_failed"], r["kept"]) for r in quality.verdicts(blank).collect()] == [(True, False)] * 2
    assert quality.kept_documents(blank).count() == 0


def test_sketches_merge_and_bound_their_error(spark):
    docs = frame(spark, some_rows())
    counted = quality.measured(docs, ["doc_id", "lang", "source"])
    fine = quality.sketches(counted, ["lang", "source"])
    whole = quality.sketches(counted.withColumn("all", F.lit(0)), ["all"]).select("rule", "bucket", "n")
    assert sorted(map(tuple, quality.merged(fine, []).select("rule", "bucket", "n").collect())) == sorted(map(tuple, whole.collect()))
    values = counted.where("n_words > 0").select(quality.value(quality.RULES[0]).alias("v"))
    buckets = {r["bucket"] for r in whole.where("rule = 'mean_word'").collect()}
    assert all(any(b <= r["v"] < b + max(1, b / 31) for b in buckets) for r in values.collect())
