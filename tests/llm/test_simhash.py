import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tessella.llm import components, simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(rows, radius=2):
    import re

    fps = []
    for _, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((i is None, i or 0, f"{fps[k]:016x}", least.get(find(k), -1)) for k, (i, _) in enumerate(rows))


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA)
    out = simhash.near_duplicates(df)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["h"], -1 if r["component_id"] is None else r["component_id"]) for r in out.select("doc_id", simhash.hexadecimal("fp").alias("h"), "component_id").collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        for _ in range(rng.choice([1, 3, 8])):
            copy = list(text)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    rows += [(5, None), (6, ""), (7, " \t\n"), (8, "a\u00a0b c"), (9, "\u00c9t\u00c9 x y"), (None, rows[0][1]), (3, rows[0][1]), (3, rows[0][1]), (None, "alone in the wood"), (4, "z " * 50_000)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_every_close_pair_collides():
    """Covering: any at most two flipped bits are hidden by some mask."""
    masks = simhash.masks(2)
    assert len(masks) == 7
    for a, b in combinations(range(64), 2):
        assert any(not (m >> a & 1) and not (m >> b & 1) for m in masks)


def test_links_are_exact_on_a_dense_cluster(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    fps = {center}
    for _ in range(1500):
        x = center
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(500)}
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    for radius in (1, 2):
        root = {simhash.signed(f): simhash.signed(f) for f in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        links = [(r["a"], r["b"]) for r in simhash.close_pairs(df, radius).collect()]
        mask = (1 << 64) - 1
        assert all(((a & mask) ^ (b & mask)).bit_count() <= radius for a, b in links)
        for a, b in links:
            root[find(a)] = find(b)
        arr = np.array(fps, dtype=np.uint64)
        for i in range(len(arr)):
            for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= radius):
                assert find(simhash.signed(fps[i])) == find(simhash.signed(fps[i + 1 + j]))


@pytest.mark.parametrize("few", [0, 50, 50_000])  # rounds only, rounds and then one task, one task
def test_components_of_chains_and_stars(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    found = {r["vertex"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 301 + 400 + 2
    assert len({found[i] for i in range(301)}) == len({found[1000 + i] for i in range(400)}) == len({found[6000], found[6001]}) == 1
    assert len(set(found.values())) == 3


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (3, "something else entirely here", "z"), (None, "a b c d", "n"), (7, None, "e"), (8, "", "e")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 7]


def jaccard(a, b, words=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_similar_documents_against_brute_force(spark):
    """The stage's contract: near copies far beyond two bits are found, and nothing under the similarity is linked."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 4])):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(copy) // 50)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 10, " ".join(copy)))
    hub = [rng.choice(words) for _ in range(300)]
    rows += [(1000 + k, " ".join(hub[:k] + ["x"] + hub[k + 1 :])) for k in range(80)]
    links = [(a, b) for (a, x), (b, y) in combinations(rows, 2) if jaccard(x, y) >= 0.8]
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    assert max((fps[a] ^ fps[b]).bit_count() for a, b in links) > 2
    root = {i: i for i, _ in rows}
    for a, b in sorted(links):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if v == old else v for k, v in root.items()}
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert got == root
    kept = simhash.first_of_each(df, groups=simhash.similar_documents(df)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root.values()))


def test_part_masks_cover_the_radius():
    masks, rng = simhash.part_masks(14), random.Random(2)
    for _ in range(5000):
        x = sum(1 << b for b in rng.sample(range(64), 14))
        assert any(not m & x for m in masks)


def test_parities_never_rule_out_a_similar_pair(spark):
    """Bits that differ between two parities are at most the hashes in which the sets differ, of the same oddness, and tell sets apart that are well under the similarity."""
    rng = np.random.default_rng(3)
    sets = {1: [], 2: [5], 3: rng.integers(-(2**63), 2**63 - 1, 40_000).tolist()}
    base = rng.integers(-(2**63), 2**63 - 1, 200).tolist()
    for k in range(10, 60):
        sets[k] = base[: 200 - k] + rng.integers(-(2**63), 2**63 - 1, k).tolist()
    df = spark.createDataFrame(list(sets.items()), "digest long, hashes array<long>")
    got = {r["digest"]: sum((w & (2**64 - 1)) << 64 * k for k, w in enumerate(r["parity"])) for r in simhash.parities(df).collect()}
    assert set(got) == set(sets)
    for a, b in combinations(sets, 2):
        bits, apart = (got[a] ^ got[b]).bit_count(), len(set(sets[a]) ^ set(sets[b]))
        assert bits <= apart and (apart - bits) % 2 == 0
    assert 1.8 * (got[10] ^ got[59]).bit_count() > 0.2 * 400  # 118 of 400 differ, 44 may


@pytest.mark.parametrize("by_size", [2, 512])  # buckets in order of size, and not
def test_second_pass_links_across_large_groups(spark, monkeypatch, by_size):
    """With one neighbour a point in the first pass, the second finds the rest; brute force over all pairs."""
    monkeypatch.setattr(simhash, "ORDERS", 1)
    monkeypatch.setattr(simhash, "BY_SIZE", by_size)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    hub = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(hub)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy[: rng.choice([30, 100, 120])])))
    root = {i: i for i, _ in rows}
    for (a, x), (b, y) in combinations(rows, 2):
        if jaccard(x, y) >= 0.8 and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()} == root
