"""SimHash near-duplicates with covering locality-sensitive hashing.

A 64-bit fingerprint of each whole text (3-word shingles, majority vote over
XXH64) is compared under structured bit masks.  For radius r every bit
position gets a non-zero vector of r + 1 bits; the mask of a non-zero vector v
keeps the positions whose vector has an odd inner product with v.  At most r
differing positions span at most r dimensions, so some v is orthogonal to all
of them and its mask hides them all: every pair within the radius collides in
at least one of the 2^(r+1) - 1 tables, for certain.

Buckets are never expanded into pairs.  Only buckets that hold two or more
different fingerprints go on; inside one, two fingerprints within distance 2
share a value at distance at most 1 from both, so each row is dealt to itself
and its single-bit flips in the hidden positions.  A group of that second deal
has at most (hidden positions + 1) fingerprints, all within distance 2 of each
other, and is linked as a star.  Exact copies are merged beforehand.

``similar_documents`` looks further: for a radius above 2 the fingerprint is
cut into three parts, one of which differs in at most a third of the radius and
collides in that part's covering family.  Fingerprints of one bucket are
compared in the task that holds it; what is near enough is decided by the exact
Jaccard similarity of the whole shingle sets.  A first pass gives every set only
``ORDERS`` neighbours as candidates, the nearest and the least in further
orders, which joins most of a large group without its pairs; a second pass over the sets with neighbours gives every
near pair whose ends are in different components so far, so none is left out;
sets that have too few shingles in common with other components stay out of it.
Before sets are fetched, a pair of the second pass is held against the parities
of both: a bit tells whether an odd number of a set's hashes fall into its
class, each hash that only one of two sets has turns one bit, so the bits that
differ are never more than the hashes that do, and a pair with too many of them
is certainly under the similarity.

Defined cases: a null, empty or blank text has fingerprint zero, which is
linked like any other; repeated rows get equal values; the component id is the
smallest non-null doc_id of the component, null if it has none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import joined
from .common import byte_values, cut
from .components import components

BITS, RADIUS, WORDS, SEED = 64, 2, 3, 42
#: For ``similar_documents``: parts of a fingerprint, orders of the first pass, and how far the second fingerprints of a candidate may differ.
PARTS, ORDERS, SECOND_RADIUS = 3, 3, 20
#: How often sets that share too few shingles are taken out before the second pass.
PRUNED = 2
#: 64-bit words of a set's parities.
PARITY = 16
#: A bucket with more rows is put in order of size before it is compared, which pays from about 500 rows on; the pairs found are the same.
BY_SIZE = 512
#: Pairs of a bucket that are held at once: where all are near, as among copies, some 15 numbers of each.
PAIRS_HELD = 1 << 18
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
POINT = "digest long, fp long, fp2 long, n int"


def shingle_hashes(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, in text order; of the whole text where it is shorter."""
    w = data.lower().split() if data else []  # of bytes: A-Z, and the six ASCII blanks, only
    if not w:
        return np.zeros(0, dtype="<u8")
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype="<u8")


def fingerprint(data: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of UTF-8 bytes; bit b is set if it is set in over half of the shingles' hashes."""
    return majority(shingle_hashes(data, words))


def majority(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(h), 65536):
        ones += np.unpackbits(h[start : start + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in byte_values(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering family for ``radius``: position i has the vector 1 + i mod (2^(radius+1) - 1)."""
    tables = (1 << (radius + 1)) - 1
    vectors = [1 + i % tables for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, tables + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between different fingerprints of column ``fp`` (unique) so that those within ``radius`` (at most 2) are connected, and no others are linked."""
    if not 0 < radius <= 2:
        raise ValueError("links by shared neighbours hold for a radius of 1 or 2")
    kept = masks(radius)
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(signed(m)).alias("mask")) for v, m in enumerate(kept)])
    keyed = distinct.select("fp", F.explode(table).alias("t")).select("fp", F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    shared = keyed.groupBy("v", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("v", "key")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in kept])
    dealt = keyed.join(shared, ["v", "key"]).select("fp", "v", F.explode(F.element_at(flips, F.col("v") + 1)).alias("flip"))
    near = dealt.select("fp", "v", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    if radius == 1:
        # the members of a group may be two apart: only those that are the group's value itself link to the others
        near = near.where("fp = z").select("v", "z").join(near, ["v", "z"]).where("fp <> z")
        return near.select(F.col("fp").alias("a"), F.col("z").alias("b")).distinct()
    groups = near.groupBy("v", "z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = groups.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b")
    return star.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    marked = cut(fingerprints(docs, text, key, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = cut(components(close_pairs(distinct.select("fp"), radius)))
    linked = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp").select("fp", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_linked = linked.join(smallest, "root").select("fp", F.struct("component_id").alias("c"))
    ids = distinct.join(of_linked, "fp", "left").select("fp", F.when(F.col("c").isNotNull(), F.col("c.component_id")).otherwise(F.col("first")).alias("component_id"), "n")
    return joined(marked, cut(ids), "fp", "n", "doc_id").select("doc_id", "fp", "component_id")


def part_masks(radius: int, parts: int = PARTS) -> list[int]:
    """Covering masks over each part of the fingerprint: at most ``radius`` differing bits leave some part with at most a share of them, which one of its masks hides."""
    tables = (1 << (radius // parts + 1)) - 1
    out = []
    for part in range(parts):
        at = range(BITS * part // parts, BITS * (part + 1) // parts)
        vectors = {i: 1 + k % tables for k, i in enumerate(at)}
        out += [sum(1 << i for i, m in vectors.items() if (m & v).bit_count() % 2) for v in range(1, tables + 1)]
    return out


def shingle_points(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest, fp, fp2, n) of (doc_id, text): of each text's set of shingles a digest, two fingerprints and the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((3, batch.num_rows), dtype=np.uint64)
            sizes = np.zeros(batch.num_rows, dtype=np.int32)
            for k, data in enumerate(byte_values(batch.column(1))):
                h = shingle_hashes(data, words)
                different = np.unique(h)
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(ODD[0])
                found[:, k] = xxhash.xxh64_intdigest(different.tobytes()), majority(h), majority(mixed ^ (mixed >> np.uint64(32)))
                sizes[k] = len(different)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.view(np.int64)), pa.array(sizes)], ["doc_id", "digest", "fp", "fp2", "n"])

    return docs.mapInArrow(run, f"doc_id long, {POINT}")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(digest, hashes) for each different set of shingles of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in byte_values(batch.column(1)):
                different = np.unique(shingle_hashes(data, words))
                digest = np.array([xxhash.xxh64_intdigest(different.tobytes())], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array([different.view(np.int64)], pa.list_(pa.int64()))], ["digest", "hashes"])

    return docs.mapInArrow(run, "digest long, hashes array<long>").dropDuplicates(["digest"])


def parities(sets: DataFrame) -> DataFrame:
    """(digest, parity) of (digest, hashes): bit c of ``parity`` is set if an odd number of the hashes are of class c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, PARITY), dtype="<i8")
            for k, hashes in enumerate(batch.column(1)):
                h = hashes.values.to_numpy().view(np.uint64) * np.uint64(ODD[1]) >> np.uint64(32)
                odd = np.bincount((h % np.uint64(64 * PARITY)).view(np.int64), minlength=64 * PARITY) & 1
                out[k] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * PARITY
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1)))], ["digest", "parity"])

    return sets.select("digest", "hashes").mapInArrow(run, "digest long, parity array<long>")


def candidates(points: DataFrame, radius: int, similarity: float, every: bool) -> DataFrame:
    """(a, b) of different points (POINT, and ``root``) whose fingerprints are within ``radius`` and whose sizes allow ``similarity``: every pair of two roots whose parities (a further column) allow it too, or each point's nearest and least neighbours only."""
    kept = part_masks(radius)
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(signed(m)).alias("mask")) for v, m in enumerate(kept)])
    columns = ["digest", "fp", "fp2", "n", "most", "root", *(["parity"] if every else [])]
    keyed = points.select(*columns, F.explode(table).alias("t"))
    keyed = keyed.select(F.xxhash64("t.v", F.col("fp").bitwiseAND(F.col("t.mask"))).alias("key"), *columns)
    width = 7 + (PARITY if every else 0)

    def near(rows: np.ndarray) -> Iterator[np.ndarray]:
        if ordered := rows.shape[1] > BY_SIZE:
            rows = rows[:, np.argsort(rows[3], kind="stable")]
        digest, fp, fp2, n, most, root = rows[:6]
        least, past = np.zeros(len(n), dtype=np.int64), np.full(len(n), len(n))
        if ordered:  # the same pairs: other sizes are too far apart to be similar
            least, past = np.searchsorted(n, similarity * n - 1e-6), np.searchsorted(n, n / similarity + 1e-6, "right")
        step = max(1, min(256, PAIRS_HELD // len(digest)))
        for start in range(0, len(digest), step):
            x = slice(start, start + step)
            y = slice(least[start], past[min(start + step, len(n)) - 1])
            close = np.bitwise_count(fp[x, None].view(np.uint64) ^ fp[y].view(np.uint64)) <= radius
            close &= digest[x, None] != digest[y]
            i, j = np.nonzero(close)
            i += start
            j += y.start
            apart = np.bitwise_count(fp2[i].view(np.uint64) ^ fp2[j].view(np.uint64))
            fit = apart <= SECOND_RADIUS
            fit &= np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
            fit &= (1 + similarity) * np.minimum(most[i], most[j]) >= similarity * (n[i] + n[j]) - 1e-6
            if every:
                fit &= (root[i] != root[j]) & (digest[i] < digest[j])
            i, j = i[fit], j[fit]
            if every:
                odd = np.zeros(len(i), dtype=np.int64)
                for word in rows[6:]:
                    odd += np.bitwise_count((word[i] ^ word[j]).view(np.uint64))
                possible = (1 + similarity) * odd <= (1 - similarity) * (n[i] + n[j]) + 1e-6
                i, j = i[possible], j[possible]
            if every and len(i):
                yield np.stack([digest[i], digest[j], i, i])
            elif len(i):
                for k, m in enumerate(ODD[:ORDERS]):
                    rank = ((digest[j].view(np.uint64) ^ np.uint64(m)) * np.uint64(m)).view(np.int64)
                    if k == 0:  # the nearest by both fingerprints: what copies of a text were made from
                        bits = apart[fit] + np.bitwise_count(fp[i].view(np.uint64) ^ fp[j].view(np.uint64))
                        rank = (bits.astype(np.int64) << 48) + (rank & ((1 << 48) - 1))
                    o = np.lexsort((rank, i))
                    o = o[np.r_[True, np.diff(i[o]) > 0]]
                    yield np.stack([digest[i[o]], digest[j[o]], np.full(len(o), k), rank[o]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((width, 0), dtype=np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                more = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:7]]
                if every:
                    more += list(batch.column(7).flatten().to_numpy().reshape(-1, PARITY).T)
                rest = np.concatenate([rest, np.stack(more)], axis=1)
            bounds = np.flatnonzero(np.diff(rest[0])) + 1
            starts = np.r_[0, bounds] if rest.shape[1] else bounds
            ends = np.r_[bounds, rest.shape[1]] if batch is None else bounds  # the last bucket may go on in the next batch
            for a, b in zip(starts, ends, strict=False):
                if b - a > 1:
                    for pairs in near(rest[1:, a:b]):
                        yield pa.RecordBatch.from_arrays([*map(pa.array, pairs)], ["a", "b", "k", "rank"])
            rest = rest[:, ends[-1] :] if len(ends) else rest

    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, k long, rank long")
    if every:
        return found.select("a", "b").distinct()
    found = found.groupBy("a", "k").agg(F.min_by("b", "rank").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, radius: int = 14, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` with a doc_id: components of the links between texts whose sets of shingles have a Jaccard similarity of at least ``similarity``, found within ``radius``."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    marked = cut(shingle_points(docs, words))
    points = cut(marked.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("fp", "fp2", "n")], F.min("doc_id").alias("first"), F.count("*").alias("rows")).withColumns({"root": F.col("digest"), "most": F.col("n")}))

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that are similar: the whole sets are compared."""
        end = lambda c: sets.select(F.col("digest").alias(c), F.col("hashes").alias(f"{c}_set"))
        both = pairs.join(end("a"), "a").join(end("b"), "b")
        shared = F.size(F.array_intersect("a_set", "b_set"))
        return cut(both.where(shared >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - shared) - 1e-6).select("a", "b"))

    first = cut(candidates(points, radius, similarity, False))
    ends = cut(first.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
    with_neighbours = cut(points.join(ends, "digest"))
    sets = cut(shingle_sets(docs.join(with_neighbours.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi"), words).join(ends, "digest", "left_semi"))
    links = linked(first, sets)
    # what is joined already needs no more pairs, however large the group
    roots = cut(components(links)).withColumnRenamed("vertex", "digest")
    apart = cut(with_neighbours.drop("root", "most").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")))
    # a shingle that no set of another component has can be in no further link: a set shares ``most`` others at most; where that is too few it goes, and may leave others too few
    held = cut(sets.join(apart.select("digest", "root"), "digest").select("digest", "root", F.explode("hashes").alias("h")))
    for _ in range(PRUNED):
        common = held.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("last")).where("least <> last").select("h")
        held = held.join(common, "h").select("digest", "root", "h")
        most = held.groupBy("digest").agg(F.count("*").alias("most"))
        apart = cut(apart.drop("most").join(most, "digest").where(F.col("most") >= F.lit(similarity) * F.col("n") - 1e-6))
        held = cut(held.join(apart.select("digest"), "digest", "left_semi"))
    parity = parities(sets.join(apart.select("digest"), "digest", "left_semi"))
    more = linked(cut(candidates(apart.join(parity, "digest"), radius, similarity, True)), sets)
    to = lambda c: apart.select(F.col("digest").alias(c), F.col("root").alias(f"{c}_root"))
    between = more.join(to("a"), "a").join(to("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    last = cut(components(between)).select(F.col("vertex").alias("root"), F.col("root").alias("last"))
    grouped = points.drop("root").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    grouped = grouped.join(last, "root", "left").withColumn("root", F.coalesce("last", "root"))
    grouped = cut(grouped.select("digest", "root", "first", "rows"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = cut(grouped.join(smallest, "root").select("digest", "component_id", "rows"))
    return joined(marked, ids, "digest", "rows", "doc_id").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """One row for each component of ``groups`` (by default those of ``near_duplicates``): the row of its smallest doc_id. Rows without a doc_id stay; rows that repeat a kept id stay where their texts differ."""
    groups = near_duplicates(docs, text, key) if groups is None else groups
    kept = cut(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    ids = lambda rows: rows.select(F.col("doc_id").alias(key))
    out = docs.join(ids(kept), key, "left_semi")
    if not (repeated := kept.where("n > 1")).isEmpty():
        out = docs.join(ids(kept.where("n = 1")), key, "left_semi").unionByName(docs.join(ids(repeated), key, "left_semi").dropDuplicates([key, text]))
    return out.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
