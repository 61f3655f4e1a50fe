"""Connected components by randomised contraction, wholly in DataFrames.

Each round every vertex picks, among itself and its neighbours, the one with
the least hash for that round; edges are rewritten to the picks.  A constant
share of the vertices goes in each round whatever the shape of the graph
(chains and stars alike), and all aggregates combine before their shuffle.
Rounds are cut in the shared folder, so a lost executor repeats one round.
Once at most ``FEW`` edges are left (a megabyte), one task joins them by
union-find; a graph that small needs no round at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_ROUNDS, FEW = 200, 50_000


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, root) of all ends of the edges (a, b) of one task."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    ends = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(map(root, ends), pa.int64())], ["vertex", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (vertex long, root long): one root for each component, for every vertex that has an edge to another one.

    Null ends, loops, repeated and mirrored edges are fine; no edge gives an empty result.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(edges)
    picks: list[DataFrame] = []
    for turn in range(MOST_ROUNDS):
        n = edges.count()
        if n <= FEW:
            if n:
                picks.append(cut(edges.coalesce(1).mapInArrow(united, "vertex long, root long")))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        pick = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("vertex"), F.least("m", rank("a")).getField("v").alias("root")))
        picks.append(pick)
        to = lambda c: pick.select(F.col("vertex").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        edges = cut(edges.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
    else:
        raise RuntimeError(f"components: edges are left after {MOST_ROUNDS} rounds")
    if not picks:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    # a vertex of round k whose pick lives on is looked up in round k + 1: from the last round back
    roots = picks[-1]
    for pick in reversed(picks[:-1]):
        later = roots.select(F.col("vertex").alias("root"), F.col("root").alias("last"))
        roots = pick.join(later, "root", "left").select("vertex", F.coalesce("last", "root").alias("root"))
    return roots
