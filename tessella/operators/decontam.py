"""Benchmark decontamination by word n-grams.

Benchmark n-grams are a distinct set.  Where its measured size allows it is
broadcast and every document is scanned in one Arrow pass, for all benchmarks
together, that sends no n-gram anywhere; larger sets are joined by a 64-bit hash of the n-gram, checked on the
n-gram itself.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LATEX, normal_form, words
from ..joins import dealt_out, joined, scratch

N = 13
#: A benchmark set of at most so many bytes is broadcast.
BROADCAST_LIMIT = 64 << 20
#: Of a larger one a Bloom filter of so many 64-bit words is (32 MiB).
BLOOM_WORDS = 1 << 22
SAMPLES = 5
_LATEX = re.compile(LATEX)
HITS = "key long, side string, n_ngrams long, hits array<string>"


def normal_words(text: str) -> list[str]:
    text = text if text.isascii() else unicodedata.normalize("NFKD", text)
    return _LATEX.sub(" ", text.lower()).split()


def ngrams_of(text: str | None, n: int) -> set[str]:
    found = normal_words(text) if text else []
    return {" ".join(found[k : k + n]) for k in range(len(found) - n + 1)}


class Hashes(dict):
    """64-bit hashes of words, kept as they come up."""

    KEPT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def windows(self, found: list[str], n: int) -> np.ndarray:
        """A 64-bit hash of every n-gram, by position."""
        h = np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))
        size = len(found) - n + 1
        out = h[:size].copy()
        for k in range(1, n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out += h[k : k + size]
        return out


def ngrams(rows: DataFrame, key: str, text: str, n: int = N) -> DataFrame:
    """(key, ngram): the distinct word n-grams of every text, by an Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams = [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = ngrams_of(value, n)
                keys += [k] * len(found)
                grams += found
                if len(keys) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.string())], ["key", "ngram"])
                    keys, grams = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.string())], ["key", "ngram"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, ngram string")


def ngrams_by_window(rows: DataFrame, key: str, text: str, n: int = N, decompose: bool = False) -> DataFrame:
    """The same without Python: words by position and ``lead`` over them. For short texts; long ones are shuffled word by word."""
    from pyspark.sql import Window

    exploded = rows.select(F.col(key).alias("key"), F.posexplode(words(normal_form(F.col(text), decompose))).alias("pos", "word"))
    order = Window.partitionBy("key").orderBy("pos")
    parts = exploded.select("key", F.lead("word", n - 1).over(order).alias("_last"), *[F.lead("word", k).over(order).alias(f"w{k}") for k in range(n)])
    return parts.where("_last is not null").select("key", F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("ngram")).distinct()


def benchmark_texts(sources: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(benchmark, text): chosen fields of each benchmark joined by a blank, null as empty."""
    out = None
    for name, (rows, fields) in sources.items():
        part = rows.select(F.lit(name).alias("benchmark"), F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


class Bloom:
    """A blocked Bloom filter of 64-bit hashes: one 64-bit word for each hash, chosen by its first bits, and three bits in it. Its size is fixed by ``words``, a power of two; what was put in is always found."""

    def __init__(self, table: np.ndarray):
        self.table, self.shift = table, np.uint64(64 - (len(table) - 1).bit_length())

    @staticmethod
    def bits(h: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        return (one << (h & low)) | (one << (h >> np.uint64(6) & low)) | (one << (h >> np.uint64(12) & low))

    def may_have(self, h: np.ndarray) -> np.ndarray:
        wanted = self.bits(h)
        return self.table[h >> self.shift] & wanted == wanted

    @classmethod
    def of(cls, grams: DataFrame, n: int, words: int) -> Bloom:
        """The filter of column ``ngram``: words are joined by tasks and in the shuffle, and the driver sees ``words`` of them at most, however many n-grams there are."""
        shift = np.uint64(64 - (words - 1).bit_length())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                h = np.array([hashes.windows(g.split(" "), n)[0] for g in batch.column(0).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((h >> shift).astype(np.int64)), pa.array(cls.bits(h).view(np.int64))], ["at", "word"])

        found = grams.select("ngram").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        table = np.zeros(words, dtype=np.uint64)
        table[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
        return cls(table)


def indexed(bench: DataFrame, n: int = N, limit: int = BROADCAST_LIMIT) -> tuple[DataFrame, Broadcast | None]:
    """The distinct n-grams of the benchmark's texts as a stored table, and, where they are of at most ``limit`` bytes, broadcast with their sorted hashes."""
    spark, path = bench.sparkSession, scratch(bench.sparkSession, "benchmark-ngrams")
    ngrams(bench.select(F.lit(0).alias("k"), "text"), "k", "text", n).select("ngram").distinct().write.parquet(path)
    index = spark.read.parquet(path)
    if (index.agg(F.sum(F.octet_length("ngram") + 64).alias("b")).first()["b"] or 0) > limit:
        return index, None
    grams, hashed = frozenset(index.toArrow().column(0).to_pylist()), Hashes()
    return index, spark.sparkContext.broadcast((grams, np.unique(np.concatenate([hashed.windows(g.split(" "), n) for g in grams] or [np.empty(0, dtype=np.uint64)]))))


def near(wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each hash whether it is one of the sorted ``wanted``."""
    return wanted[np.minimum(np.searchsorted(wanted, at), max(0, len(wanted) - 1))] == at if len(wanted) else np.zeros(len(at), dtype=bool)


def side_hits(rows: DataFrame, bench: DataFrame, key: str, sides: list[str], n: int = N, limit: int = BROADCAST_LIMIT, bloom_words: int = BLOOM_WORDS) -> DataFrame:
    """(key, side, n_ngrams, hits): for every row and side with n-grams, the distinct ones that the benchmark has.

    A benchmark of at most ``limit`` bytes is broadcast whole.  Of a larger one
    a Bloom filter of ``bloom_words`` 64-bit words is, and the n-grams that it
    lets through (the hits, and a few others) are looked up in the benchmark's
    n-grams by a join.
    """
    index, known = indexed(bench, n, limit)
    spark = rows.sparkSession
    sided = dealt_out(rows).select(F.col(key).cast("long").alias("key"), F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("text")) for s in sides])).alias("s")).select("key", "s.side", "s.text")
    bloom = None if known else spark.sparkContext.broadcast(Bloom.of(index, n, bloom_words).table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        if known:
            grams_known, wanted = known.value
        else:
            likely = Bloom(bloom.value)
        for batch in batches:
            counts, hits = [], []
            for text in batch.column(2).to_pylist():
                found = normal_words(text) if text else []
                if len(found) < n:
                    counts.append(0)
                    hits.append([])
                    continue
                at = hashes.windows(found, n)
                counts.append(len(np.unique(at)))
                if known is None:
                    hits.append(sorted({" ".join(found[k : k + n]) for k in np.flatnonzero(likely.may_have(at))}))
                    continue
                hits.append(sorted({" ".join(found[k : k + n]) for k in np.flatnonzero(near(wanted, at))} & grams_known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.string()))], ["key", "side", "n_ngrams", "hits"])

    scanned = sided.mapInArrow(scan, HITS).where("n_ngrams > 0")
    if known:
        return scanned
    path = scratch(spark, "likely-hits")  # small: what the filter lets through
    scanned.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)  # repeated keys stay apart, as in the scan
    scanned = spark.read.parquet(path)
    exploded = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("ngram"))
    path = scratch(spark, "hit-ngrams")
    exploded.groupBy("ngram").agg(F.count("*").alias("_n")).join(index, "ngram").withColumn("hit", F.col("ngram")).write.parquet(path)
    # an n-gram of a passage that many rows share comes by a broadcast
    certain = joined(exploded, spark.read.parquet(path), "ngram", "_n", "row").groupBy("row").agg(F.array_sort(F.collect_list("hit")).alias("certain"))
    return scanned.join(certain, "row", "left").select("key", "side", "n_ngrams", F.coalesce("certain", F.array().cast("array<string>")).alias("hits"))


def contaminated(rows: DataFrame, benchmarks: dict[str, DataFrame], key: str, sides: list[str], n: int = N, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row per record and benchmark with hits: hits of each side and in all, the share of all its n-grams, and sample n-grams in order."""
    names = list(benchmarks)
    texts = [bench.select(F.lit(order).alias("order"), "text") for order, bench in enumerate(benchmarks.values())]
    if not texts:
        raise ValueError("no benchmark is given")
    every = functools.reduce(DataFrame.unionByName, texts)
    found = side_hits(rows, every, key, sides, n, limit)
    some = F.collect_list(F.when(F.size("hits") > 0, F.struct("side", "hits")))
    records = found.groupBy("key").agg(F.sum("n_ngrams").alias("n_ngrams"), some.alias("s")).where(F.size("s") > 0)
    grams = records.select("key", "n_ngrams", F.explode("s").alias("s")).select("key", "n_ngrams", "s.side", F.explode("s.hits").alias("ngram"))
    if len(names) == 1:
        grams = grams.withColumn("order", F.lit(0))
    else:
        grams = grams.join(ngrams(every, "order", "text", n).distinct().withColumnRenamed("key", "order"), "ngram")
    per = [F.count_if(F.col("side") == s).alias(f"{s}_hits") for s in sides]
    one = grams.groupBy("key", "n_ngrams", "order").agg(*per, F.count("*").alias("total_hits"), F.collect_set("ngram").alias("all_hits"))
    return one.select(
        F.col("key").alias(key), F.element_at(F.array(*map(F.lit, names)), F.col("order").cast("int") + 1).alias("benchmark"), F.col("order").cast("int").alias("benchmark_order"), *[f"{s}_hits" for s in sides], "total_hits",
        F.round(F.col("total_hits") / F.greatest(F.col("n_ngrams"), F.lit(1)), 6).alias("overlap_ratio"), F.slice(F.array_sort("all_hits"), 1, SAMPLES).alias("sample_ngrams"),
    )


def merged(hits: DataFrame, key: str, sides: list[str]) -> DataFrame:
    """One row per record: hits summed over benchmarks, names joined in their order, the ratio of the first, samples of the first and three of each further one."""
    ordered = F.array_sort(F.collect_list(F.struct("benchmark_order", "benchmark", "overlap_ratio", "sample_ngrams")))
    found = hits.groupBy(key).agg(*[F.sum(f"{s}_hits").alias(f"{s}_hits") for s in sides], F.sum("total_hits").alias("total_hits"), ordered.alias("all"))
    return found.select(
        key, *[f"{s}_hits" for s in sides], "total_hits",
        F.array_join(F.transform("all", lambda x: x["benchmark"]), "+").alias("benchmarks"), F.col("all")[0]["overlap_ratio"].alias("overlap_ratio"),
        F.flatten(F.transform("all", lambda x, k: F.when(k == 0, x["sample_ngrams"]).otherwise(F.slice(x["sample_ngrams"], 1, 3)))).alias("sample_ngrams"),
    )


def drop_summary(rows: DataFrame, bad: str, hit: str) -> DataFrame:
    """original, bad, contaminated, both, either, remaining."""
    return rows.agg(
        F.count("*").alias("original"), F.count_if(F.col(bad)).alias("bad"), F.count_if(F.col(hit)).alias("contaminated"),
        F.count_if(F.col(bad) & F.col(hit)).alias("intersection"), F.count_if(F.col(bad) | F.col(hit)).alias("dropped"), F.count_if(~(F.col(bad) | F.col(hit))).alias("remaining"),
    )


def cleaned(rows: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose key is in ``drop``."""
    return rows.join(drop.select(key).distinct(), key, "left_anti")
