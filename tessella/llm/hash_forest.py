"""Approximate nearest neighbours with a forest of hash prefixes.

A tree is a sorted array of long hash strings, one bit for each of ``BITS``
directions, drawn orthogonal to each other, that says on which side of the
shard's mean a vector lies.  A query descends every tree to its longest
matching prefix by binary search; then all trees ascend together, one bit at a
time, and every row that shares the shortened prefix in some tree becomes a
candidate, until there are ``SHARE`` of the shard's rows.  Candidates are
ordered by their true distance.

The embeddings at hand are spread evenly over the sphere (the nearest of
50,000 is at two thirds of the median distance), where any method must look at
much of the data: in shards of over 640 rows the 48 trees come to about half of
the rows by the time they have 0.4; see the README.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part; a shorter vector counts as filled up with zeros;
every row but those of the query's id is a candidate, repeated rows each; a
repeated query id is answered once, for its least vector; fewer candidates than
asked for are all returned; further columns, whatever they are called, take no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from .vector_grid import search, usable

TREES, BITS, SEED = 48, 24, 20_24
#: A query looks at this share of a shard's rows at least, and at so many rows at least.
SHARE, LEAST_CANDIDATES = 0.4, 256


def directions(width: int) -> np.ndarray:
    """(width, TREES * BITS): the directions of a tree are orthogonal as far as the width allows."""
    rng = np.random.default_rng(SEED)
    per_tree = [[np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-BITS // width))] for _ in range(TREES)]
    return np.concatenate([np.concatenate(blocks, axis=1)[:, :BITS] for blocks in per_tree], axis=1)


class Forest:
    def __init__(self, v: np.ndarray):
        self.v, self.middle, self.sides = v, v.mean(axis=0), directions(v.shape[1])
        strings = self.strings(v)
        self.order = np.argsort(strings, axis=0, kind="stable")  # a column for each tree
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def strings(self, v: np.ndarray) -> np.ndarray:
        """Rows x trees: the hash strings, first bit highest."""
        bits = ((v - self.middle) @ self.sides > 0).reshape(len(v), TREES, BITS)
        return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def candidates(self, string: np.ndarray, wanted: int) -> np.ndarray:
        n = len(self.v)
        seen = np.zeros(n, dtype=bool)
        # descend: the range of rows under each prefix length in each tree
        shift = np.arange(BITS, -1, -1)  # bits cut off at depth 0, 1, ..
        low = (string[:, None] >> shift) << shift
        first, last = np.empty_like(low), np.empty_like(low)
        for tree in range(TREES):
            first[tree] = np.searchsorted(self.sorted[:, tree], low[tree])
            last[tree] = np.searchsorted(self.sorted[:, tree], low[tree] + (np.int64(1) << shift))
        for depth in range(BITS, -1, -1):  # ascend, all trees in step
            if (last[:, depth] - first[:, depth]).sum() and (depth == BITS or ((last[:, depth] - first[:, depth]) > (last[:, depth + 1] - first[:, depth + 1])).any()):
                for tree in range(TREES):
                    seen[self.order[first[tree, depth] : last[tree, depth], tree]] = True
                if np.count_nonzero(seen) >= wanted:
                    break
        return np.flatnonzero(seen)


class Index:
    """A shard's forest, built once, and its answers to the queries that stream past it."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.forest = Forest(v)
        self.wanted = max(LEAST_CANDIDATES, int(np.ceil(SHARE * len(ids))))

    def answers(self, query_ids: np.ndarray, asked: np.ndarray) -> Iterator[tuple]:
        for query_id, q, string in zip(query_ids, asked, self.forest.strings(asked), strict=True):
            at = self.forest.candidates(string, self.wanted)
            at = at[self.ids[at] != query_id]
            distance = np.sqrt(((self.v[at] - q) ** 2).sum(axis=1))
            best = np.lexsort((self.ids[at], distance))[: self.k]
            yield query_id, self.ids[at][best], distance[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found, by Euclidean distance."""

    return search(usable(vectors, key, embedding, zero=False), is_query, k, True, "double", lambda ids, v: Index(ids, v, k))
