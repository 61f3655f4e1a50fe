"""Best-fit packing of tokenised documents after a Martello-Toth dominance reduction.

Spark tokenises whole documents, cuts those over the capacity (the first piece
is the shorter one) and counts the pieces by length.  At most ``capacity``
lengths exist, so this histogram is the whole packing instance in bounded
space: equal pieces are interchangeable and are packed in multiples.

On the histogram, largest length first, sets that provably dominate every
alternative are fixed for good (``reduce_dominated``), and what is left is
packed best-fit in decreasing order (``best_fit``).  Both return patterns: a
list of lengths with the number of sequences that look like it, a few
thousand at most.  Spark then ranks the pieces of each length, in buckets so
that a length that most documents share is dealt to many tasks, and joins each
rank to its pattern's slot; nothing but histogram and patterns passes through
the driver.

Defined cases: null texts are empty (the end id only); repeated rows are
packed each; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import KEPT_PARTS, Encoder

#: Parts of texts that a worker of the pipeline keeps with their ids: it holds other stages' memory beside them.
KEPT_BESIDE = 200_000

CAPACITY = 1024
#: Ranks are numbered in buckets of about so many pieces.
BUCKET_ROWS = 50_000

Pattern = tuple[tuple[int, ...], int]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix, from the largest length down, the sets that dominate all others holding that length; the second value is what is left.

    A length for which no such set exists stays, and counts among the others
    for all smaller ones.
    """
    left, fixed = {x: n for x, n in counts.items() if n}, []
    for j in sorted(left, reverse=True):
        while j in left and (others := dominating(left, j, capacity - j)) is not None:
            items = (j, *others)
            need = {x: items.count(x) for x in items}
            times = min(left[x] // n for x, n in need.items())
            fixed.append((items, times))
            for x, n in need.items():
                left[x] -= n * times
                if not left[x]:
                    del left[x]
    return fixed, left


def dominating(left: dict[int, int], j: int, room: int) -> tuple[int, ...] | None:
    """What to put beside a piece of length ``j`` so that no other choice from ``left`` can be better; None if that isn't certain.

    A choice is no better if its pieces, alone or several together, fit one by
    one into the place of those chosen here: the choice can then be swapped
    in, and what comes out takes its pieces' places elsewhere.
    """
    have = {x: n - (x == j) for x, n in left.items() if x <= room and n > (x == j)}
    if not have:
        return ()
    lengths = sorted(have)
    k = lengths[-1]  # no single piece is longer
    smallest = [x for x in lengths[:3] for _ in range(min(3, have[x]))][:3]
    if k == room or len(smallest) < 2 or sum(smallest[:2]) > room:
        return (k,)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None  # three fit: too many choices
    pair = best_pair(lengths, have, room)
    if k >= sum(pair):
        return (k,)
    # beside k, the longest that fits: it covers every pair unless both pieces of one are longer than it
    second = [x for x in lengths[: bisect_left(lengths, room - k + 1)] if x != k or have[k] > 1]
    if second:
        longer = [x for x in lengths[bisect_left(lengths, second[-1] + 1) :][:2] for _ in range(min(2, have[x]))][:2]
        if len(longer) < 2 or sum(longer) > room:
            return (k, second[-1])
    return None


def best_pair(lengths: list[int], have: dict[int, int], room: int) -> tuple[int, int]:
    """The two pieces of the largest sum that fit into ``room``; (0, 0) if none do. ``lengths``: those of ``have``, ascending."""
    best, low, high = (0, 0), 0, len(lengths) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > room:
            high -= 1
        else:
            if (a != b or have[a] > 1) and a + b > sum(best):
                best = (b, a)
            low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: each length goes to the fullest open sequences that take it, many at a time."""
    open_: dict[int, list[list]] = {}  # room -> [items, times]
    rooms: list[int] = []
    closed: list[Pattern] = []

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if not room:
            closed.append((items, times))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([items, times])

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put(capacity - each * length, (length,) * each, whole)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            items, times = open_[room][-1]
            each = min(room // length, n)  # the same sequence stays the fullest that fits
            whole = min(times, n // each)
            open_[room][-1][1] -= whole
            if not open_[room][-1][1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            put(room - each * length, items + (length,) * each, whole)
            n -= each * whole
    return closed + [(items, times) for room in open_.values() for items, times in room]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_dominated(counts, capacity)
    return [p for p in fixed + best_fit(rest, capacity) if p[1]]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", kept: int = KEPT_PARTS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, kept)
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, data in zip(ids, map(encoder.encode, batch.column(1).to_pylist()), strict=True):
                data += end
                total = len(data) // 4
                start, size = 0, total % capacity or capacity
                piece = 0
                while start < total:
                    for column, value in zip(out, (doc_id, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])), strict=True):
                        column.append(value)
                    start, size, piece = start + size, capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (with doc_id, piece, length) plus sequence_id and offset."""
    spark: SparkSession = cut_pieces.sparkSession
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length
    slots, first_sequence = [], 0
    used: dict[int, int] = {}
    for items, times in patterns(counts, capacity):
        offset = 0
        for length in items:
            rank = used.get(length, 0)
            slots.append((length, rank, rank + times, first_sequence, offset))
            used[length] = rank + times
            offset += length
        first_sequence += times
    # slots of a length are contiguous ranges of ranks: split at multiples of the bucket so that ranges join on (length, bucket)
    total = max(1, sum(counts.values()))
    buckets = max(64, -(-total // BUCKET_ROWS))
    places = spark.createDataFrame(slots, "length long, low long, high long, first long, offset long")
    order = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    dealt = cut_pieces.withColumn("bucket", order)
    per_bucket = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"), "n")
    # the slots that a bucket's ranks reach, as one sorted array for each (length, bucket)
    reach = starts.join(places, (starts["length"] == places["length"]) & (F.col("low") < F.col("from") + F.col("n")) & (F.col("high") > F.col("from")))
    reach = reach.groupBy(starts["length"], "bucket").agg(F.max("from").alias("from"), F.array_sort(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("slots"))
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("in_bucket", F.row_number().over(inner) - 1).join(reach, ["length", "bucket"]).withColumn("rank", F.col("from") + F.col("in_bucket"))
    slot = F.expr("filter(slots, s -> s.low <= rank and rank < s.high)[0]")
    return ranked.withColumn("slot", slot).select(*[F.col(c) for c in cut_pieces.columns], (F.col("slot.first") + F.col("rank") - F.col("slot.low")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", kept: int = KEPT_PARTS) -> DataFrame:
    return packed(cut(pieces(docs, tokenizer, end_id, capacity, text, key, kept)), capacity)
