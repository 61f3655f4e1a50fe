"""Agreement, token batches, statistics and generators of one's own, digests of large files; each against a plain version."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import agreement, batches, extensions
from tessella.sources import scans

CATEGORIES = ["a", "b", "c"]


def ac1(items):
    """(agreement, chance, AC1) of lists of ratings; None is an error."""
    items = [[r for r in x if r in CATEGORIES] for x in items]
    items = [x for x in items if x]
    several = [x for x in items if len(x) > 1]
    if not several:
        return None, None, None
    observed = sum(sum(x.count(c) * (x.count(c) - 1) for c in CATEGORIES) / (len(x) * (len(x) - 1)) for x in several) / len(several)
    share = [sum(x.count(c) / len(x) for x in items) / len(items) for c in CATEGORIES]
    chance = sum(p * (1 - p) for p in share) / 2
    return observed, chance, (observed - chance) / (1 - chance)


def test_ac1_and_its_jackknife(spark):
    rng = random.Random(4)
    groups = {g: [[rng.choice(["a", "a", "b", "c", None, "?"][: 3 + 3 * (rng.random() < 0.5)]) for _ in range(rng.randrange(1, 6))] for _ in range(n)] for g, n in (("x", 40), ("y", 7), (None, 12))}
    groups |= {"alone": [["a", None]], "one": [["a", "b", "a"]], "errors": [[None, None], [None]], "same": [["b", "b"], ["b", "b", "b"], ["b"]]}
    rows = [(g, k, r) for g, items in groups.items() for k, item in enumerate(items) for r in item]
    got = {r["g"]: r for r in agreement.gwet_ac1(spark.createDataFrame(rows, "g string, item int, rating string"), ["g"], "item", F.col("rating"), CATEGORIES).collect()}
    assert set(got) == set(groups) - {"errors"}
    for g in ("x", "y", None, "one", "same"):
        observed, chance, value = ac1(groups[g])
        assert (got[g]["agreement"], got[g]["chance"], got[g]["ac1"]) == (pytest.approx(observed), pytest.approx(chance), pytest.approx(value))
        rated = [x for x in groups[g] if any(r in CATEGORIES for r in x)]
        assert got[g]["n_items"] == len(rated)
        if len(rated) > 1:
            left = np.array([ac1(rated[:k] + rated[k + 1 :])[2] for k in range(len(rated))])
            width = 1.96 * math.sqrt((len(left) - 1) / len(left) * ((left - left.mean()) ** 2).sum())
            assert (got[g]["lo"], got[g]["hi"]) == (pytest.approx(value - width), pytest.approx(value + width))
    assert got["alone"]["ac1"] is None and got["one"]["lo"] is None and got["same"]["ac1"] == 1
    with pytest.raises(ValueError, match="two categories"):
        agreement.gwet_ac1(spark.range(1), [], "id", F.lit("a"), ["a"])


def plain_batch(ids, wide, pad):
    return [(x + [pad] * (wide - len(x)), [1] * len(x) + [0] * (wide - len(x)), x + [-100] * (wide - len(x))) for x in ids]


@pytest.mark.parametrize("arrow_rows", [3, 10_000])
def test_padding(spark, arrow_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        rng = random.Random(2)
        ids = [[rng.randrange(1, 900) for _ in range(rng.randrange(0, 30))] for _ in range(23)]
        rows = [(k, x if k != 5 else None, "clash") for k, x in enumerate(ids)]
        ids[5] = []
        frame = spark.createDataFrame(rows, "k int, ids array<int>, labels string").coalesce(1)
        of = lambda found: {r["k"]: (r["input_ids"], r["attention_mask"], r["labels"]) for r in found.collect()}
        fixed = batches.padded(frame, "ids", length=12, pad_id=3)
        assert fixed.columns == ["k", "ids", "input_ids", "attention_mask", "labels"]
        assert of(fixed) == dict(enumerate(plain_batch([x[:12] for x in ids], 12, 3)))
        longest = of(batches.padded(frame, "ids", most=20, pad_id=3, batch=4))
        for start in range(0, 23, 4):
            some = [x[:20] for x in ids[start : start + 4]]
            assert [longest[start + k] for k in range(len(some))] == plain_batch(some, max(map(len, some)), 3)
        assert of(batches.padded(frame, "ids", length=0)) == {k: ([], [], []) for k in range(23)}
        assert batches.padded(frame.limit(0), "ids").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_statistic_and_a_generator_from_sql(spark):
    def fails_on_negatives(x, w, z) -> float:
        if (x < 0).any():
            raise ValueError("negative")
        return float((x * w * z).sum())

    extensions.register_statistic(spark, "weighted", fails_on_negatives)
    rows = [("a", 1.0, 2.0, 1.0), ("a", 3.0, None, 1.0), ("a", 5.0, 1.0, 2.0), ("b", -1.0, 1.0, 1.0), ("c", None, 1.0, 1.0)]
    spark.createDataFrame(rows, "g string, x double, w double, z double").createOrReplaceTempView("some_rows")
    got = {r["g"]: r["v"] for r in spark.sql("SELECT g, weighted(x, w, z) AS v FROM some_rows GROUP BY g").collect()}
    assert got == {"a": 12.0, "b": None, "c": None}
    extensions.register_generator(spark, "made_pairs", lambda seed: [(k, f"{seed}-{k}", None) for k in range(seed)], "attempt int, target string, retain string")
    got = spark.sql("SELECT id, attempt, target, retain FROM range(4), LATERAL made_pairs(id)").collect()
    assert sorted(map(tuple, got)) == [(i, k, f"{i}-{k}", None) for i in range(4) for k in range(i)]


def test_digests_of_files_beyond_the_reader(spark, tmp_path):
    """Spark's reader of whole files refuses them at this limit; digests are read in pieces."""
    content = {"large.bin": bytes(range(256)) * 20_000, "empty.bin": b"", "sub/a b.txt": "ä".encode() * 7}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1_000_000)
    try:
        with pytest.raises(Exception, match="(?i)max.?length|exceed"):
            spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select(F.sha2("content", 256)).collect()
        got = {r["file"]: (r["bytes"], r["sha256"], r["md5"]) for r in scans.checksums(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    want = {n.rsplit("/", 1)[-1]: (len(d), hashlib.sha256(d).hexdigest(), hashlib.md5(d).hexdigest()) for n, d in content.items()}
    assert got == want
