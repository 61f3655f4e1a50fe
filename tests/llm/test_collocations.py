"""Collocations against plain counting, with small shards, filters and ranges."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, depth, least, first, share=100):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts = f.setdefault(lang, Counter())
            for d in range(1, depth + 1):
                counts.update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, counts in f.items():
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in phrases.items():
            for d in range(2, len(p)):
                for i in range(len(p) - d + 1):
                    inside[p[i : i + d]] = max(inside[p[i : i + d]], a)
        rows_of = []
        for p, a in phrases.items():
            if p in inside and 100 * inside[p] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), " ".join(p), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p, -a, x, y, n[lang], -s) for r, (s, a, _, p, x, y) in enumerate(sorted(rows_of)[:first], 1)]
    return sorted(out)


def texts():
    import random

    rng = random.Random(5)
    names = ["the", "of", "new", "york", "city", "straße", "Été", "a\x01", "a", "ab", "x y", "ﬁ"]
    rows = [(" ".join(rng.choice(names) + rng.choice(["", "", "", ",", ". ", "\n"]) for _ in range(rng.randrange(120))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    rows += [("New York City is new york CITY. " * 30, "en"), ("in the city of new york " * 40, "en"), (None, "en"), ("", "fr"), ("., ;\n", "es"), (" one\ttwo  three ", "it")]
    rows += [("alpha beta gamma delta epsilon zeta " * 25, "de")] * 3
    return [*rows, ("k l m n o p q " * 60_000, "pt")]


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(docs, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("depth", "least", "first", "share", "shard", "bits"), [(5, 20, 2000, 100, 2_000_000, 26), (5, 10, 7, 80, 500, 8), (3, 5, 2000, 100, 50, 12), (2, 5, 2000, 100, 5000, 26)])
def test_plain_counts(spark, monkeypatch, depth, least, first, share, shard, bits):
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    rows = texts()
    assert found(spark, rows, depth=depth, least=least, first=first, share=share, shard_words=shard, bits=bits) == brute(rows, depth, least, first, share)


def test_walk_across_many_ranges(spark):
    """Ranges that begin below a node of an earlier range, and ranges in between that have nothing."""
    nodes = [("en", list(w), a) for w, a in [("a", 99), ("ab", 50), ("abc", 40), ("abcd", 30), ("abd", 9), ("b", 70), ("ba", 60)]] + [("fr", list(w), a) for w, a in [("a", 5), ("ab", 4)]]
    expected = {(lang, "".join(w)): [dict((("".join(x), n)) for of, x, n in nodes if of == lang)["".join(w[:k])] for k in range(1, len(w))] for lang, w, _ in nodes}
    for parts in ([0] * 9, range(9), [0, 0, 3, 3, 3, 7, 7, 8, 8], [2, 2, 2, 2, 5, 5, 6, 6, 9]):
        rows = [(*node, part) for node, part in zip(nodes, parts, strict=True)]
        frames = [spark.createDataFrame([r for r in rows if r[3] == p], "lang string, words array<string>, a long, part int").coalesce(1) for p in sorted(set(parts))]
        frame = frames[0]
        for more in frames[1:]:
            frame = frame.union(more)
        got = {(r["lang"], "".join(r["words"])): r["lefts"] for r in collocations.walked(frame).collect()}
        assert got == expected


def test_numbers_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    phrases = spark.createDataFrame([("en", ["x", "y", "z"], 10**14, [10**15, 10**14], [10**14, 10**15], big)], "lang string, words array<string>, a long, lefts array<long>, rights array<long>, n long")
    assert [r["score"] for r in collocations.scored(phrases).collect()] == [1000 * 10**14 * big // 10**29]


def test_hot_phrase_and_empty_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = [("hot phrase here", "en")] * 500 + [("hot words", "en")] * 250
    docs = spark.createDataFrame(rows, "text string, lang string")
    for c in ("h", "n", "a", "words", "w1", "part", "link", "rank", "phrase", "salt"):
        docs = docs.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute(rows, 5, 100, 2000)
