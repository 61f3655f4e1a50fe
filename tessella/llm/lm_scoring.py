"""Scoring documents by a subword lattice: the probability of a text is summed over all its segmentations.

The vocabulary is that of a stored sentencepiece model.  No unigram model is at
hand, only one of byte-pair merges, whose scores rank the pieces: they are the
prior of a unigram model (1 / (rank + 10), normalised)
which one expectation step over the word counts of the training documents
turns into probabilities.  A word, with the mark of a word's start before it,
is a lattice over its UTF-8 bytes: an edge for every piece that matches, and
one for each single byte, so every text has a probability.  A forward
recursion in log space gives the word's marginal probability; pieces never
reach over white space, so a document's is the product over its words and one
end symbol.

Words are counted in Spark over all documents and each distinct word's lattice
is solved once, in the word table.  Words that make up at least one
``HEAVY``-th of all tokens, hence at most ``HEAVY`` words, are broadcast;
all rarer ones, none of which can be a hot key, are joined by the word.

Defined cases: null, empty and blank texts consist of the end symbol only;
without training documents the prior scores alone weigh the lattice and N is
0; repeated rows are scored each; very long words are one long lattice.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, cut

#: Words of at least total / HEAVY tokens are broadcast: at most HEAVY of them.
HEAVY = 500_000
#: No more bytes of words than this are broadcast: where they would be more, only those of more tokens are.
HEAVY_BYTES = 16 << 20
#: No word can hold a newline: it stands for the end of a document.
END = b"\n"
START = "▁".encode()
SMOOTHING = 0.1
#: Counts are sent on when a task holds so many words.
HELD_WORDS = 400_000
MISSING = object()


def read_pieces(path: str) -> list[tuple[bytes, float]]:
    """(bytes, prior weight) of each piece of a sentencepiece model, then of single bytes it lacks."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            continue
        shown = model.id_to_piece(k)
        data = bytes([int(shown[3:5], 16)]) if model.is_byte(k) else shown.encode()
        rank = model.get_piece_size() if model.is_byte(k) else -model.get_score(k)
        found[data] = found.get(data, 0.0) + 1.0 / (10.0 + rank)
    for b in range(256):
        found.setdefault(bytes([b]), 1.0 / (10.0 + model.get_piece_size()))
    return sorted(found.items())


class Lattice:
    """Natural log probabilities of pieces by their bytes; prefixes that are no pieces map to None."""

    def __init__(self, pieces: list[tuple[bytes, float]]):
        total = sum(w for _, w in pieces)
        self.at: dict[bytes, tuple[int, float] | None] = {}
        for data, _ in pieces:
            for end in range(1, len(data)):
                self.at.setdefault(data[:end], None)
        for k, (data, weight) in enumerate(pieces):
            self.at[data] = (k, math.log(weight / total))

    def edges(self, word: bytes) -> list[list[tuple[int, int, float]]]:
        """For each position the (end, piece, log probability) of the pieces that start there."""
        at, out = self.at, []
        for i in range(len(word)):
            here = []
            for j in range(i + 1, len(word) + 1):
                found = at.get(word[i:j], MISSING)
                if found is MISSING:
                    break
                if found is not None:
                    here.append((j, *found))
            out.append(here)
        return out

    def forward(self, word: bytes) -> float:
        """The log probability of ``word`` over all segmentations."""
        at, n = self.at, len(word)
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for i in range(n):
            a = alpha[i]
            if a is None:
                continue
            for j in range(i + 1, n + 1):
                found = at.get(word[i:j], MISSING)
                if found is MISSING:
                    break
                if found is not None:
                    x, y = a + found[1], alpha[j]
                    alpha[j] = x if y is None else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return alpha[n]

    def expect(self, word: bytes, weight: float, into: np.ndarray) -> None:
        """Add ``weight`` times the expected uses of each piece in ``word``."""
        n, edges = len(word), self.edges(word)
        alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        alpha[0] = beta[n] = 0.0
        exp, log1p = math.exp, math.log1p
        for i in range(n):
            a = alpha[i]
            for j, _, p in edges[i]:
                x, y = a + p, alpha[j]
                alpha[j] = (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))) if y > -math.inf else x
        for i in range(n - 1, -1, -1):
            total = -math.inf
            for j, _, p in edges[i]:
                x = p + beta[j]
                total = (x + log1p(exp(total - x)) if x > total else total + log1p(exp(x - total))) if total > -math.inf else x
            beta[i] = total
        whole = alpha[n]
        for i in range(n):
            for j, k, p in edges[i]:
                into[k] += weight * exp(alpha[i] + p + beta[j] - whole)


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, c, a): tokens in training documents and in all, of (text, held_out); the end symbol is one of the words."""

    def rows(train: Counter, rest: Counter) -> pa.RecordBatch:
        words = list(train.keys() | rest.keys())
        c = [train[w] for w in words]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([x + rest[w] for x, w in zip(c, words, strict=True)], pa.int64())], ["word", "c", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()
        for batch in batches:
            for data, held_out in zip(byte_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                to = rest if held_out else train
                to.update(data.lower().split() if data else ())
                to[END] += 1
                if len(train) + len(rest) > HELD_WORDS:
                    yield rows(train, rest)
                    train, rest = Counter(), Counter()
        if train or rest:
            yield rows(train, rest)

    parts = docs.select("text", "held_out").mapInArrow(run, "word binary, c long, a long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def fit(words: DataFrame, pieces: list[tuple[bytes, float]]) -> tuple[list[tuple[bytes, float]], float]:
    """Piece weights after one expectation step over the training words, and the log probability that the text ends where a word could begin."""
    spark = words.sparkSession
    prior = spark.sparkContext.broadcast(pieces)
    size = len(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, expected = Lattice(prior.value), np.zeros(size)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.expect(START + word, c, expected)
        used = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(expected[used])], ["piece", "n"])

    sums = words.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    seen = words.agg(F.sum("c").alias("all"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    ends, tokens = (seen["ends"] or 0) + SMOOTHING, (seen["all"] or 0) + 2 * SMOOTHING
    prior_total = sum(w for _, w in pieces)
    weights = [SMOOTHING * size * w / prior_total for _, w in pieces]
    for row in sums:
        weights[row["piece"]] += row["n"]
    return [(data, w) for (data, _), w in zip(pieces, weights, strict=True)], math.log(ends / tokens)


def score(docs: DataFrame, held_out: Column, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = cut(count_words(docs))
    pieces, end_log = fit(counts, read_pieces(vocabulary))
    model = spark.sparkContext.broadcast((pieces, math.log1p(-math.exp(end_log))))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, goes_on = model.value
        lattice = Lattice(found)
        for batch in batches:
            # before each word it is drawn that the text goes on
            logs = [(lattice.forward(START + w) + goes_on) / math.log(10) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], ["word", "c", "a", "p"])

    words = cut(counts.where(F.col("word") != F.lit(END)).mapInArrow(solve, "word binary, c long, a long, p double"))
    totals = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("a").alias("a"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    n, v, ends = totals["n"] or 0, totals["v"] or 0, totals["ends"] or 0
    least = max(2, -(-(totals["a"] or 0) // HEAVY))
    while least < (totals["a"] or 0) and (words.where(F.col("a") >= least).agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0) > HEAVY_BYTES:
        least *= 2
    heavy_rows = words.where(F.col("a") >= least).select("word", "c", "p").toArrow()
    heavy = spark.sparkContext.broadcast({w: (math.log10(c + SMOOTHING), c > 0, p) for w, c, p in zip(*(heavy_rows.column(k).to_pylist() for k in range(3)), strict=True)})
    end_p, end_base = end_log / math.log(10), math.log10(ends + SMOOTHING)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for batch in batches:
            rows, rare, times = [], [], []
            sums: list[tuple] = []
            for row, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(3)), strict=True):
                found = data.lower().split() if data else ()
                base, sure, p, before = end_base, int(ends > 0), end_p, len(rare)
                for word, tf in Counter(found).items():
                    got = known.get(word)
                    if got is None:
                        rare.append(word)
                        times.append(tf)
                    else:
                        base += tf * got[0]
                        sure += tf * got[1]
                        p += tf * got[2]
                rows += [row] * (len(rare) - before)
                sums.append((len(found) + 1, sure, base, p))
            own = batch.column(0).to_pylist()
            none = pa.nulls(len(rare))
            long, double = pa.int64(), pa.float64()
            keys = pa.array(rare + [END + r.to_bytes(8, "little") for r in own], pa.binary())
            column = lambda k, t: pa.concat_arrays([none.cast(t), pa.array([s[k] for s in sums], t)])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows + own, long), keys, pa.array(times + [0] * len(own), pa.int32()), pa.concat_arrays([none.cast(long), batch.column(1).cast(long)]), pa.concat_arrays([none.cast(pa.bool_()), batch.column(2)]), column(0, long), column(1, long), column(2, double), column(3, double)],
                ["row", "word", "tf", "doc_id", "held_out", "n_tokens", "n_known", "base", "p"],
            )

    schema = "row long, word binary, tf int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, p double"
    parts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(look_up, schema)
    table = words.where(F.col("a") < least).select("word", "c", F.col("p").alias("word_p"))
    joined = parts.join(table, "word", "left")
    tf, c = F.col("tf"), F.col("c")
    found = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.bool_or("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(c > 0, tf).otherwise(F.lit(0)))).alias("n_known"),
        F.sum(F.coalesce("base", tf * F.log10(c + F.lit(SMOOTHING)))).alias("base"),
        F.sum(F.coalesce("p", tf * F.col("word_p"))).alias("score"),
    )
    each = math.log10(n + SMOOTHING * (v + 1))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")
