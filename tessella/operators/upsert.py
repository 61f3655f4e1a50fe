"""Keyed state: latest-wins upserts that never lose a key, resume by anti-join, ordered lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The greatest row of each key by ``order``; an aggregate, so no partition holds a key's history."""
    payload = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], timestamp: str) -> DataFrame:
    """Every key of either side once: the strictly newer row, on a tie the existing one. A missing timestamp is the oldest."""
    both = existing.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)), allowMissingColumns=True)
    return latest(both, keys, [F.coalesce(F.col(timestamp).cast("string"), F.lit("")), F.col("_old")]).drop("_old")


def carry_forward(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Metadata: the new value where there is one, else the old."""
    a, b = existing.alias("a"), new.alias("b")
    names = [c for c in existing.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key), *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in names])


def remaining(seeds: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Seeds whose key was not written yet; repeated seeds stay repeated."""
    return seeds.join(done.select(*keys).distinct(), keys, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, key: str, order: list[Column], how: str = "left") -> DataFrame:
    """Join with the last row of ``table`` for each key."""
    return rows.join(latest(table, [key], order), key, how)


def preference_triples(target: DataFrame, opposite: DataFrame, key: str, order: list[Column], columns: tuple[str, str, str]) -> DataFrame:
    """(key, chosen, rejected): target and retain of the target table against the opposite; only keys that both have."""
    chosen, rejected, other = columns
    right = latest(opposite, [key], order).select(key, F.col(other).alias("_other"))
    return target.join(right, key, "inner").select(key, F.col(chosen).alias("chosen"), F.coalesce(F.col("_other"), F.col(rejected)).alias("rejected"))


def merge_maps(old: Column, new: Column) -> Column:
    """Right-biased union of maps."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)
