"""Phrase collocations from depth-limited count tries.

A shard (a bounded number of words that one task has read) becomes a trie of
its phrases of at most five words with their counts: level by level, a node is
a pair of the node above it and a word, so a level is one sort of integers.  A
phrase can only be frequent if its pairs and triples of words are, so a
counting pass comes first: each shard sorts the 64-bit hashes of its pairs and
triples, cuts them to ranges of hashes and packs each range's run (differences
and counts, compressed); ranges are merged, each in one task, and there are
more of them the more partitions the session shuffles to.  What is frequent goes
into a bit table of fixed size, broadcast to the pass that builds the tries.
It is only a filter: phrases that share a hash or a bit cost a few nodes, no
result, for the tries hold the words themselves, so every count of the result
is exact.  Their first level has every word, which gives the sizes of languages.

Tries are serialised in order of their paths, written to the shared folder,
dealt to tasks by ranges of paths (not by first words, so a very frequent first
word is many ranges) and merged there.  In a merged range a walk in order has
the counts of all prefixes of a node on its way: these are the left parts.  A
range may begin below a node of the range before it; what is open at the end of
each range, five words at most, is handed on.  The right parts come by suffix
links: the node of a phrase without its first word has the first of them and,
by its own link, the others.

Scores are computed in whole numbers of any length.  A phrase inside a longer
one of (nearly) its own count is dropped; counts never grow with length, so it
is enough to look at the phrases one word longer, which are its children in the
trie and the nodes whose suffix link it is.

Defined cases: null and empty texts and texts of delimiters have no words; null
languages are ``und``, like that language itself; repeated rows count each
time; equal scores go by count, then by the bytes of the phrase; an empty table
gives no row; further columns, whatever they are called, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..joins import dealt_out
from .common import attached, byte_values, cut, fresh_path

#: Words of a phrase, its least count, phrases a language, and the share (of a hundred) of a phrase's count that makes a longer one take its place.
MOST_WORDS, LEAST, FIRST, SHARE = 5, 100, 2000, 100
#: Words of a shard, and the binary logarithm of the bits of a filter.
SHARD_WORDS, FILTER_BITS = 2_000_000, 26
DELIMITERS, UND = b".,;:!?\n\x0b\x0c\r", "und"
#: Stands between pieces; no word holds it.
STOP = b"."
#: Bytes of text that are cut into words at once, and rows of an Arrow batch.
CHUNK, ROWS = 4 << 20, 65536
ENDS = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
SEED, MIX = 42, np.uint64(0x9E3779B97F4A7C15)


def lowered() -> bytes:
    """A byte table: A-Z in lower case, all delimiters as newlines."""
    table = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    for b in DELIMITERS:
        table[b] = ord("\n")
    return bytes(table)


TABLE = lowered()


class Numbers(dict):
    """Numbers of the words of a shard in the order of their first use; that of STOP is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class Shard:
    """The words of one language that a task has gathered."""

    def __init__(self):
        self.numbers = Numbers({STOP: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        words = b"\n".join([*texts, b""]).translate(TABLE).replace(b"\n", b" . ").split()
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def closed(self) -> tuple[list[bytes], np.ndarray]:
        """The words in byte order (STOP first) and the shard as their places there, from 0 on."""
        names = list(self.numbers)
        order = [0, *sorted(range(1, len(names)), key=names.__getitem__)]
        place = np.empty(len(names), dtype=np.int64)
        place[order] = np.arange(len(names))
        return [names[k] for k in order], place[np.concatenate(self.parts)]


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words, places) of the shards of (language, text) rows."""
    held: dict[str, Shard] = {}
    texts: dict[str, list[bytes]] = {}
    waiting = 0

    def add() -> None:
        for lang, some in texts.items():
            held.setdefault(lang, Shard()).add(some)
        texts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
                waiting += len(text)
            if waiting >= CHUNK:
                add()
                waiting = 0
                if sum(s.size for s in held.values()) >= most:
                    yield from ((of, *shard.closed()) for of, shard in held.items())
                    held.clear()
    add()
    yield from ((of, *shard.closed()) for of, shard in held.items())


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


def joined_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * MIX) ^ (right + (left >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Filter:
    """A bit table of 64-bit hashes: never false for one that was put in."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = table, np.uint64(64 - (8 * len(table) - 1).bit_length())

    def of(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def packed(h: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """(range, size, run) of sorted hashes and their counts: a range has the hashes with its number in their first ``bits`` bits; of the next 32 bits the differences, and the counts, are kept byte by byte, which compresses well."""
    of = (h >> np.uint64(64 - bits)).astype(np.int64)
    low = ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    runs = []
    for start, end in zip(starts, [*starts[1:], len(of)], strict=True):
        both = np.concatenate([np.diff(low[start:end], prepend=np.uint32(0)), n[start:end].astype(np.uint32)])
        runs.append(pa.compress(both.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True))
    sizes = np.diff(np.append(starts, len(of))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int32)), pa.array(sizes), pa.array(runs, pa.binary())], ["range", "size", "run"])


def unpacked(size: int, run: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The second part of the hashes, and the counts."""
    both = np.frombuffer(pa.decompress(run, 8 * size, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]
    return np.cumsum(both[:size], dtype=np.uint32), both[size:].astype(np.int64)


def counted_grams(texts: DataFrame, most: int, bits: int) -> DataFrame:
    """(range, size, run) of (lang, text): the packed counts of the pairs and triples of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, w in shards(batches, most):
            h = word_hashes(lang, words)
            inside = (w[:-1] != 0) & (w[1:] != 0)
            at, node, above, found = np.flatnonzero(inside), w[:-1][inside], h, []
            for d in (2, 3):
                if d == 3:
                    on = at + 1 < len(inside)
                    on[on] = inside[at[on] + 1]
                    at, node = at[on], node[on]
                pairs, node, n = np.unique(node * len(words) + w[at + d - 1], return_inverse=True, return_counts=True)
                above = joined_hashes(above[pairs // len(words)], h[pairs % len(words)])
                found.append((above, n))
            h, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h)
            if len(h):
                yield packed(h[order], n[order], bits)

    return texts.mapInArrow(run, "range int, size int, run binary")


def frequent_hashes(runs: DataFrame, least: int, bits: int) -> DataFrame:
    """(h): the first ``bits`` + 32 bits of the hashes that are counted ``least`` times at least over all runs; a range is merged in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = -1

        def merged_range() -> Iterator[pa.RecordBatch]:
            if held:
                low, n = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(low, kind="stable")  # of sorted runs
                low, n = low[order], n[order]
                starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
                often = low[starts][np.add.reduceat(n, starts) >= least].astype(np.uint64)
                h = (np.uint64(at) << np.uint64(64 - bits)) | (often << np.uint64(32 - bits))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
            held.clear()

        for batch in batches:
            for number, size, packed_run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at:
                    yield from merged_range()
                    at = number
                held.append(unpacked(size, packed_run))
        yield from merged_range()

    return runs.repartition("range").sortWithinPartitions("range").mapInArrow(run, "h long")


def filter_of(hashes: DataFrame, bits: int = FILTER_BITS) -> Broadcast:
    """The table of a Filter of the hashes ``h``. The driver sees its words only, 2^(bits - 5) at most, however many hashes there are."""
    at = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 5), dtype="<u4")
    table[words["k"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return hashes.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def trie(w: np.ndarray, grams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a shard in the order of their paths, and their counts: rows of ``depth`` places, 0 past the end. The k-th of ``grams`` says of each place whether the k + 2 words from it on may be frequent."""
    size = int(w.max(initial=0)) + 1
    n = np.bincount(w, minlength=size)
    n[0] = 0
    here = np.flatnonzero(n)
    levels = [(here[:, None], n[here])]
    at, node, path = np.flatnonzero(grams[0]), w[grams[0]], np.arange(size)[:, None]
    for d in range(2, depth + 1):
        if d > 2:  # the last words of the path
            last = grams[min(d, len(grams) + 1) - 2]
            on = last[at + d - min(d, len(grams) + 1)]
            at, node = at[on], node[on]
        pairs, node, n = np.unique(node * size + w[at + d - 1], return_inverse=True, return_counts=True)
        path = np.column_stack([path[pairs // size], pairs % size])
        levels.append((path, n))
    rows = np.concatenate([np.pad(p, ((0, 0), (0, depth - p.shape[1]))) for p, _ in levels])
    order = np.lexsort(rows.T[::-1])
    return rows[order], np.concatenate([n for _, n in levels])[order]


def frequent_places(w: np.ndarray, h: np.ndarray, filter_: Filter) -> list[np.ndarray]:
    """For each place whether a frequent pair, and whether a frequent triple may begin there; false where the shard ends before."""
    after = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])
    pair = (w != 0) & (after(w, 1) != 0)
    of_pair = joined_hashes(h[w[pair]], h[after(w, 1)[pair]])
    pair[pair] = hit = filter_.of(of_pair)
    triple = pair & after(pair, 1)
    triple[triple] = filter_.of(joined_hashes(of_pair[hit][triple[pair]], h[after(w, 2)[triple]]))
    return [pair, triple]


def tries(texts: DataFrame, grams_often: Broadcast, depth: int, most: int) -> DataFrame:
    """(lang, w1, w2, ..., n) of (lang, text): the nodes of the shards' tries in order of their paths."""
    names = [*(f"w{k + 1}" for k in range(depth)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, w in shards(batches, most):
            rows, n = trie(w, frequent_places(w, word_hashes(lang, words), Filter(grams_often.value)), depth)
            texts_of = pa.array(words, pa.binary()).cast(pa.string())
            for start in range(0, len(n), ROWS):
                some = rows[start : start + ROWS]
                columns = [texts_of.take(pa.array(c, mask=c == 0)) for c in some.T]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), *columns, pa.array(n[start : start + ROWS])], ["lang", *names])

    return texts.mapInArrow(run, ", ".join(["lang string", *(f"{c} string" for c in names[:-1]), "n long"]))


def merged(parts: DataFrame, depth: int, least: int) -> DataFrame:
    """(lang, words, a, part): the nodes of all tries that are counted ``least`` times at least, merged in ranges of paths and in order; ``part`` numbers the ranges."""
    path = ["lang", *(f"w{k + 1}" for k in range(depth))]
    whole = parts.repartitionByRange(*path).groupBy(*path).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    words = F.array_compact(F.array(*path[1:])).alias("words")
    return cut(whole.sortWithinPartitions(*path).select("lang", words, "a", F.spark_partition_id().alias("part")))


Open = tuple[str, list[str], list[int | None]]


def stepped(above: Open | None, lang: str, words: list[str], a: int) -> Open:
    """What is open at a node: its language, its path and the counts of the prefixes of that, by what was open before; None for a count that was not on the way."""
    counts: list[int | None] = [None] * (len(words) - 1)
    if above and above[0] == lang:
        for k, (x, y, n) in enumerate(zip(words[:-1], above[1], above[2], strict=False)):
            if x != y:
                break
            counts[k] = n
    return lang, words, [*counts, a]


def walked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``lefts``, the counts of each node's prefixes."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Open | None = None
        part = 0
        for batch in batches:
            for row in batch.to_pylist():
                last, part = stepped(last, row["lang"], row["words"], row["a"]), row["part"]
        if last:
            yield pa.RecordBatch.from_pylist([{"part": part, "lang": last[0], "words": last[1], "counts": last[2]}], ENDS)

    handed: dict[int, Open] = {}
    last: Open | None = None
    for row in sorted(nodes.mapInArrow(ends, "part long, lang string, words array<string>, counts array<long>").collect()):
        if last:
            handed[row["part"]] = last
        before = stepped(last, row["lang"], row["words"], row["counts"][-1])
        last = (row["lang"], row["words"], [mine if mine is not None else theirs for mine, theirs in zip(row["counts"], before[2], strict=True)])
    given = nodes.sparkSession.sparkContext.broadcast(handed)  # at most ``depth`` words a range

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Open | None = None
        begun = False
        for batch in batches:
            rows = batch.to_pylist()
            lefts = []
            for row in rows:
                if not begun:
                    at, begun = given.value.get(row["part"]), True
                at = stepped(at, row["lang"], row["words"], row["a"])
                lefts.append(at[2][:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lefts, pa.list_(pa.int64()))], ["lang", "words", "a", "lefts"])

    return nodes.mapInArrow(walk, "lang string, words array<string>, a long, lefts array<long>")


def linked(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of two words and more with ``rights``, the counts of their suffixes, the longest first."""
    sized = lambda d: nodes.where(F.size("words") == d)
    below = sized(1).select("lang", F.col("words").alias("link"), F.array(F.col("a")).alias("of_link"))
    found = []
    for d in range(2, depth + 1):
        rows = sized(d).withColumn("link", F.slice("words", 2, d - 1))
        level = cut(attached(rows, below, ["lang", "link"], salt="words").withColumnRenamed("of_link", "rights").drop("link"))
        found.append(level)
        below = level.select("lang", F.col("words").alias("link"), F.concat(F.array("a"), "rights").alias("of_link"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def undominated(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases that are in no longer one of at least ``share`` hundredths of their count."""
    longer = phrases.where(F.size("words") > 2)
    inside = [longer.select("lang", F.slice("words", at, F.size("words") - 1).alias("words"), F.col("a").alias("of_longer")) for at in (1, 2)]
    most = inside[0].unionByName(inside[1]).groupBy("lang", "words").agg(F.max("of_longer").alias("of_longer"))
    kept = phrases.join(most, ["lang", "words"], "left").where(F.coalesce(100 * F.col("of_longer") < share * F.col("a"), F.lit(True)))
    return kept.drop("of_longer")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) at the cut of the lowest score, in whole numbers of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                worth = [(1000 * row["a"] * row["n"] // (x * y), k, x, y) for k, (x, y) in enumerate(zip(row["lefts"], row["rights"], strict=True))]
                score, _, x, y = min(worth)
                out.append({"lang": row["lang"], "phrase": " ".join(row["words"]), "a": row["a"], "l": x, "r": y, "n": row["n"], "score": score})
            yield from pa.Table.from_pylist(out).to_batches()

    return phrases.mapInArrow(run, "lang string, phrase string, a long, l long, r long, n long, score long")


def first_of_each(phrases: DataFrame, first: int, salts: int = 64) -> DataFrame:
    """The ``first`` phrases of each language with their rank: of a share each, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = MOST_WORDS, least: int = LEAST, first: int = FIRST, share: int = SHARE, shard_words: int = SHARD_WORDS, bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to ``depth`` words of the highest scores of each language."""
    texts = dealt_out(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UND)).alias("lang"), F.col(text).cast("string").alias("text")))
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "tries")
    ranges = max(4, min(20, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    grams_often = filter_of(frequent_hashes(counted_grams(texts, shard_words, ranges), least, ranges), bits)
    tries(texts, grams_often, depth, shard_words).write.parquet(path)
    parts = spark.read.parquet(path)
    nodes = cut(walked(merged(parts, depth, least)))
    phrases = cut(linked(nodes, depth))
    sizes = parts.where("w2 is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return first_of_each(scored(attached(undominated(phrases, share), sizes, ["lang"], salt="words")), first)
