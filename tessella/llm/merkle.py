"""A Merkle manifest of a dataset: a digest of every row, one root over all, and a proof for each row.

Rows are leaves of one tree for each group (language), in order of their id;
eight consecutive nodes make the next level's node, and the groups' roots make
the last tree.  Spark sorts the leaves by ranges and numbers them from the
counts of the ranges, deals them into blocks of 8^``LEVELS`` consecutive leaves
and reduces each block to its root in the task that holds it.  Blocks' roots
are reduced in the same way until at most ``TOP`` are left, whatever the
number of rows, so what the driver sees is bounded: it builds the
top of the tree, and every block's suffix path (the siblings from its root up)
is broadcast.  In a second pass over the same blocks the tasks finish the
proofs and fold every row up to the root again.

A block holds consecutive leaves of one group, so a group with a third of all
rows is many blocks.  Texts stay where they are: only digests are shuffled.

Defined cases: nulls in any field are encoded as ``-`` and so differ from empty
strings; a null group comes before all others; rows without an id come first in
their group and are never tampered with; rows that repeat an id are ordered by
their digests, equal rows have equal leaves (and proofs of their own places);
an empty table has no root and gives no row; further columns, whatever they are
called, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, attached, cut

ARITY = 8
#: Levels that one task reduces (a block is ARITY ** LEVELS nodes), and how many blocks' roots the driver takes at most.
LEVELS, TOP = 4, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What is made of each node: of leaves the manifest's rows, of others the suffix path of the block below.
MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATHS = "tree string, block long, subroot string, path array<struct<left:string,right:string>>"
ARROW = {
    MANIFEST: pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]),
    PATHS: pa.schema([("tree", pa.string()), ("block", pa.int64()), ("subroot", pa.string()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]),
}
Pair = tuple[str, str]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


def levels_over(nodes: list[str], above: int) -> list[list[str]]:
    """``nodes`` and ``above`` levels over them."""
    out = [nodes]
    for _ in range(above):
        last = out[-1]
        out.append([digest("".join(last[k : k + ARITY])) for k in range(0, len(last), ARITY)])
    return out


def paths(levels: list[list[str]]) -> list[list[Pair]]:
    """For each node of the lowest level its siblings, level by level: those to its left and those to its right, as text."""
    found: list[list[Pair]] = [[] for _ in levels[-1]]
    for level in reversed(levels[:-1]):
        runs = [level[k : k + ARITY] for k in range(0, len(level), ARITY)]
        found = [[("".join(run[:k]), "".join(run[k + 1 :])), *found[r]] for r, run in enumerate(runs) for k in range(len(run))]
    return found


def folded(node: str, path: Iterable[Pair]) -> str:
    """The root that ``node`` leads to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def proof(path: Iterable[Pair]) -> str:
    return digest("".join(left + right for left, right in path))


def leaf(fields: Iterable[Column]) -> Column:
    """SHA-256 over the fields, each ``-`` or its UTF-8 length, a colon and itself."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, tampered) of each row; ``tampered`` is the leaf of the row with a lower-case text, where that column is true."""
    changed = leaf([lower_ascii(F.col(c)) if c == text else F.col(c) for c in fields])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null comes first
    put = F.lit(None).cast("string") if tampered is None else F.when(tampered, changed)
    return docs.select(tree.alias("tree"), F.col(key).cast("long").alias("doc_id"), leaf([F.col(c) for c in fields]).alias("leaf"), put.alias("tampered"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` in their tree and its ``size``: sorted by ranges, numbered from the counts of the ranges, so no task holds a tree."""
    by = ["tree", *order, "_place"]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())  # spreads equal rows over ranges
    numbered = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_place").withColumn("_at", F.monotonically_increasing_id())
    numbered = cut(numbered.withColumn("_part", F.shiftright("_at", 33)))
    tree = Window.partitionBy("tree")
    counts = numbered.groupBy("tree", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.sum("n").over(tree.orderBy("_part")) - F.col("n") - F.col("first")
    counts = cut(counts.select("tree", "_part", before.alias("shift"), F.sum("n").over(tree).alias("size")))
    found = attached(numbered, counts, ["tree", "_part"], salt="_at")
    return found.withColumn("rank", F.col("_at") + F.col("shift")).drop("_at", "_part", "shift")


def blocks_of(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes (tree, rank, size, ...) dealt so that a task holds whole blocks of consecutive ranks, in order."""
    width = F.lit(ARITY**levels)
    placed = nodes.withColumns({"offset": F.col("rank") % width, "block": F.floor(F.col("rank") / width).cast("long")})
    return placed.repartition("tree", "block").sortWithinPartitions("tree", "rank")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after another."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != (held[0]["tree"], held[0]["block"]):
                yield held
                held = []
            if row["rank"] - len(held) != (held[0]["rank"] if held else row["rank"]):
                raise ValueError("nodes are not in the order of their ranks")
            held.append(row)
    if held:
        yield held


def reduced(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, rank, size, node) of each block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            first = rows[0]
            over = levels_over([r["node"] for r in rows], min(levels, depth(first["size"])))
            size = -(-first["size"] // ARITY**levels)
            yield pa.RecordBatch.from_pylist([{"tree": first["tree"], "rank": first["block"], "size": size, "node": over[-1][0]}])

    return blocks.select("tree", "rank", "size", "block", "node").mapInArrow(run, "tree string, rank long, size long, node string")


def with_paths(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """``blocks`` with the root of their group and their suffix path, each on the first row of a block only."""
    up = upper.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.lit(0).cast("long").alias("_first"), "subroot", "path")
    length = F.aggregate("path", F.lit(300), lambda n, p: n + 32 + F.length(p.left) + F.length(p.right))
    size = up.agg(F.sum(length)).first()[0] or 0
    same = (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_block")) & (F.col("offset") == F.col("_first"))
    if size <= BROADCAST_LIMIT:
        return blocks.join(F.broadcast(up), same, "left")
    return blocks.join(up, same, "left").repartition("tree", "block").sortWithinPartitions("tree", "rank")


def descended(blocks: DataFrame, levels: int, columns: str, made: Callable[[dict, list[Pair], str], dict]) -> DataFrame:
    """What ``made`` makes of each node of ``blocks`` (with paths), its whole path and the root of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            first = rows[0]
            suffix = [(p["left"], p["right"]) for p in first["path"]]
            own = paths(levels_over([r["node"] for r in rows], min(levels, depth(first["size"]))))
            yield from pa.Table.from_pylist([made(r, p + suffix, first["subroot"]) for r, p in zip(rows, own, strict=True)], ARROW[columns]).to_batches()

    return blocks.mapInArrow(run, columns)


def top_tree(rows: list[Row], last: bool) -> tuple[str, list[tuple[str, int, str | None, list[Pair]]]]:
    """The root over at most TOP nodes, and (tree, block, root of the group, suffix path) of each; ``last`` if they are all of the last tree."""
    trees: dict[str, list[Row]] = {}
    for row in sorted(rows, key=lambda r: (r["tree"].encode(), r["rank"])):
        trees.setdefault(row["tree"], []).append(row)
    over = {tree: levels_over([r["node"] for r in nodes], depth(len(nodes))) for tree, nodes in trees.items()}
    subroots = [levels[-1][0] for levels in over.values()]
    final = levels_over(subroots, depth(len(subroots)))
    found = []
    for (tree, nodes), subroot, upper in zip(trees.items(), subroots, paths(final), strict=True):
        found += [(tree, r["rank"], None if last else subroot, p + upper) for r, p in zip(nodes, paths(over[tree]), strict=True)]
    return final[-1][0], found


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text", tampered: Column | None = None, levels: int = LEVELS, top: int = TOP
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    ``folded_root`` is folded from the row as it is where ``tampered`` is not
    true, else from the row with its text in lower case, with the siblings of
    the manifest; ``verified`` says whether it is the root.
    """
    spark = docs.sparkSession
    nodes = ranked(leaves(docs, fields, key, group, text, tampered), ["doc_id", "leaf"]).withColumnRenamed("leaf", "node")
    stages: list[tuple[DataFrame, bool]] = []
    last = of_groups = False
    while True:
        blocks = cut(blocks_of(nodes, levels))
        stages.append((blocks, of_groups))
        roots = cut(reduced(blocks, levels))
        n = roots.count()
        if n <= top:
            break
        of_groups = not last and roots.where("size > 1").isEmpty()
        if of_groups:  # more groups than the driver takes: their roots are the leaves of one more tree
            last = True
            nodes = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("below"), F.lit(0).cast("long").alias("below_block"), "node"), ["below"])
        else:
            nodes = roots.select("tree", "rank", "size", "node", F.col("tree").alias("below"), F.col("rank").alias("below_block"))
    if not n:
        return spark.createDataFrame([], MANIFEST)
    root, found = top_tree(roots.collect(), last)
    upper = spark.createDataFrame(found, PATHS)
    for blocks, of_groups in reversed(stages[1:]):

        def inner(row: dict, path: list[Pair], subroot: str | None, of_groups: bool = of_groups) -> dict:
            steps = [{"left": a, "right": b} for a, b in path]
            return {"tree": row["below"], "block": row["below_block"], "subroot": row["node"] if of_groups else subroot, "path": steps}

        upper = cut(descended(with_paths(blocks, upper), levels, PATHS, inner))

    def row_of(row: dict, path: list[Pair], subroot: str) -> dict:
        ends = folded(row["tampered"] or row["node"], path)
        return {"doc_id": row["doc_id"], "leaf": row["node"], "subroot": subroot, "root": root, "proof_sha256": proof(path), "folded_root": ends, "verified": ends == root}

    return descended(with_paths(stages[0][0], upper), levels, MANIFEST, row_of)
