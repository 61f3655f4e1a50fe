"""Exact top-k by MaxScore over integer vectors.

A component is a term, its value the weight of the posting.  A shard knows for
every term the largest and smallest weight, hence the most that the term can
add to a query's score.  With the k-th best score so far as threshold, terms
are taken in order of that bound: those whose bounds together stay below the
threshold are non-essential, as no row found in their postings alone can
compete.  The postings of essential terms (the rows where a term adds
something) are traversed; what they find is scored on the essential terms and
then probed in the non-essential ones, a few at a time, while the partial
score plus the bounds left can still reach the threshold.  Shards are merged
on (score, id).

Defined cases: vectors that are null or hold null or non-finite components
take no part; a shorter vector lacks the further terms; every row is a
candidate, so a repeated row appears as often as it is there, a repeated query
id is answered once, for its least vector; scores beyond the range of a long
are held at its ends; further columns, whatever they are called, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from .vector_grid import search, usable

SCALE = 256
#: Rows are traversed so many at a time; the threshold rises in between. Non-essential terms are probed so many at a time.
CHUNK, PROBED = 2048, 8
LONG = 1 << 63


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles; these hold every such integer that comes from a float."""
    return np.floor(SCALE * v)


class Shard:
    """The weights of a shard's rows by term, and each term's postings: the rows with a positive weight and those with a negative one, in order."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, np.ascontiguousarray(weights.T)  # a row for each term, ids ascending
        self.most, self.least = self.weights.max(axis=1, initial=-np.inf), self.weights.min(axis=1, initial=np.inf)
        self.postings = [tuple(np.flatnonzero(side).astype(np.int32) for side in (w > 0, w < 0)) for w in self.weights]
        self.scored = 0  # rows that a query's essential postings led to

    def found(self, terms: np.ndarray, q: np.ndarray, start: int, end: int) -> np.ndarray:
        """The rows from ``start`` to ``end`` in the postings of ``terms`` that add something to ``q``."""
        hit = np.zeros(end - start, dtype=bool)
        for t in terms:
            rows = self.postings[t][0 if q[t] > 0 else 1]
            a, b = np.searchsorted(rows, (start, end))
            hit[rows[a:b] - start] = True
        return start + np.flatnonzero(hit)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        bound = np.maximum(np.maximum(q * self.most, q * self.least), 0)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # rest[i]: what terms i.. in that order can add
        ids, scores = np.empty(0, dtype=np.int64), np.empty(0)
        for start in range(0, len(self.ids), CHUNK):
            end = min(start + CHUNK, len(self.ids))
            threshold = scores[k - 1] if len(scores) >= k else -np.inf
            essential = len(order)
            if threshold > 0:
                essential = int(np.searchsorted(-rest, -threshold, side="right"))  # rest[essential] < threshold
                rows = self.found(order[:essential], q, start, end)
            else:
                rows = np.arange(start, end)
            rows = rows[self.ids[rows] != query_id]
            self.scored += len(rows)
            partial = q[order[:essential]] @ self.weights[order[:essential]][:, rows]
            at = essential
            while at < len(order) and len(rows):
                competes = partial + rest[at] >= threshold
                rows, partial = rows[competes], partial[competes]
                terms = order[at : at + PROBED]
                partial = partial + q[terms] @ self.weights[terms][:, rows]
                at += PROBED
            keep = partial >= threshold
            ids, scores = np.concatenate([ids, self.ids[rows[keep]]]), np.concatenate([scores, partial[keep]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


class Index:
    """A shard, built once, and its answers to the queries that stream past it."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, quantised(v), k
        self.largest = np.abs(self.v).max(initial=0)
        self.shard = Shard(ids, self.v)

    def answers(self, query_ids: np.ndarray, asked: np.ndarray) -> Iterator[tuple]:
        asked = quantised(asked)
        fits = self.largest * np.abs(asked).max(axis=1, initial=0) * max(1, self.v.shape[1]) < 2.0**53  # else doubles would round
        for query_id, q, fit in zip(query_ids, asked, fits, strict=True):
            found, scores = self.shard.top(query_id, q, self.k) if fit else exact_top(self.ids, self.v, query_id, q, self.k)
            yield query_id, found, np.array([int(s) for s in scores], dtype=np.int64)


def exact_top(ids: np.ndarray, weights: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """The same answer in unbounded integers, for weights whose products doubles can't hold."""
    whole = [int(x) for x in q]
    scored = sorted((-sum(a * int(b) for a, b in zip(whole, row, strict=True)), int(i)) for i, row in zip(ids, weights, strict=True) if i != query_id)[:k]
    return np.array([i for _, i in scored], dtype=np.int64), [max(-LONG, min(LONG - 1, -s)) for s, _ in scored]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of every query."""

    return search(usable(vectors, key, embedding, zero=True), is_query, k, False, "long", lambda ids, v: Index(ids, v, k))
