"""The Merkle manifest against a plain tree, with small blocks so that every way through it is taken."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import merkle
from tessella.llm.common import id_remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def lower(text):
    return None if text is None else "".join(c.lower() if c.isascii() else c for c in text)


def tree(nodes):
    """(root, for each node the siblings by level as (before, after))."""
    at, steps = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = range(i // 8 * 8, min(len(nodes), i // 8 * 8 + 8))
            steps[k].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        nodes = [h("".join(nodes[j : j + 8])) for j in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], steps


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    roots, low = [], {}
    for g in order:
        mine = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        root, steps = tree([leaf(*r) for r in mine])
        roots.append(root)
        low[g] = (mine, steps)
    root, high = tree(roots)
    out = []
    for g, subroot, upper in zip(order, roots, high, strict=True):
        for r, steps in zip(*low[g], strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r[0], lower(r[1]) if changed else r[1], *r[2:])
            for a, b in steps + upper:
                node = h(a + node + b)
            out.append((r[0], leaf(*r), subroot, root, h("".join(a + b for a, b in steps + upper)), node, node == root))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(docs, tampered=id_remainder(F.col("doc_id"), 3) == 0, **more)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def some_rows():
    rows = [(i, f"Text {i} With CAPITALS" if i % 4 else f"plain {i}", "en" if i < 150 else "de", f"s{i % 3}", i) for i in range(200)]
    rows += [(300, "X", None, None, None), (301, None, "fr", "s", 0), (302, "", "", "s", 0), (303, "ÀÉ Ab", "éß", "s", 5), (304, "é" * 300_000, "en", "s", 1)]
    return rows + [(7, "same id", "en", "s", 1), (8, "twice", "en", "s", 2), (8, "twice", "en", "s", 2), (None, "No ID", "en", "s", 1), (None, None, None, None, None)]


@pytest.mark.parametrize(("levels", "top"), [(4, 4096), (1, 4096), (1, 9), (2, 2)])
def test_manifest_is_the_plain_tree(spark, levels, top):
    rows = some_rows()
    assert found(spark, rows, levels=levels, top=top) == brute(rows)


def test_more_groups_than_the_driver_takes(spark):
    rows = [(i, f"Word {i}", f"l{i % 70}", "s", i) for i in range(300)]
    assert found(spark, rows, levels=1, top=3) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_at_the_edges_of_runs(spark, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    assert found(spark, rows, levels=1, top=2) == brute(rows)


def test_tampering_shows(spark):
    rows = [(i, "Some Text", "en", "s", 9) for i in range(30)] + [(i, "no capitals", "en", "s", 9) for i in range(30, 60)]
    for doc_id, *_, verified in found(spark, rows):
        assert verified == (doc_id >= 30 or zlib.crc32(str(doc_id).encode()) % 3 != 0)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = some_rows()[:20]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "leaf", "node", "rank", "block", "size", "path", "root", "offset", "below", "_at"):
        docs = docs.withColumn(c, F.lit("x"))
    got = merkle.manifest(docs, tampered=id_remainder(F.col("doc_id"), 3) == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_paths_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_LIMIT", 0)
    rows = some_rows()
    assert found(spark, rows, levels=1, top=9) == brute(rows)
