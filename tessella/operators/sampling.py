"""Seeded splits, samples and seed grids; the order is a hash that any engine can recompute.

Ranks inside a stratum are only needed up to its quota, so rows beyond a
hash bound that surely holds the quota are never sorted (``_near``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import order_key


def shuffled_take(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in seeded order."""
    return rows.withColumn("_o", order_key(F.col(key), seed=seed)).orderBy("_o", key).limit(n).drop("_o")


def cells(rows: DataFrame, strata: list[str]) -> DataFrame:
    """Every stratum with its number in sorted order, its size, and how many strata there are."""
    counts = rows.groupBy(*strata).agg(F.count("*").alias("cell_rows"))
    order = Window.orderBy(*strata)  # one row for each stratum
    return counts.withColumns({"cell": F.row_number().over(order) - 1, "n_cells": F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})


def quota(holdout: int) -> Column:
    """Equal shares, one more for the first cells; never more than a cell has, and what it lacks is not made up elsewhere."""
    return F.least(F.floor(F.lit(holdout) / F.col("n_cells")) + (F.col("cell") < F.lit(holdout) % F.col("n_cells")).cast("int"), F.col("cell_rows")).cast("long")


def _near(order: Column, wanted: Column, size: Column) -> Column:
    """Whether an order key lies below a bound that holds the first ``wanted`` of ``size`` rows but for one chance in millions of millions."""
    position = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return position <= (wanted + 8 * F.sqrt(wanted + 1) + 40) / size


def ranked(rows: DataFrame, strata: list[str], key: str, sizes: DataFrame, wanted: Column, seed: int) -> DataFrame:
    """The rows that may be among the first ``wanted`` of their stratum, with ``rank`` from 1."""
    near = rows.join(F.broadcast(sizes), _same(rows, sizes, strata)).drop(*[sizes[s] for s in strata]) if strata else rows.crossJoin(F.broadcast(sizes))
    near = near.withColumns({"_o": order_key(F.col(key), seed=seed), "_wanted": wanted})
    near = near.where(_near(F.col("_o"), F.col("_wanted"), F.col("cell_rows")))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", key)))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    found = a[names[0]].eqNullSafe(b[names[0]])
    for n in names[1:]:
        found = found & a[n].eqNullSafe(b[n])
    return found


def stratified_split(rows: DataFrame, strata: list[str], key: str, holdout: int, seed: int = 0) -> DataFrame:
    """Adds ``split``: holdout for the first rows of every cell up to its quota, train for all others. ``key`` is unique."""
    held = ranked(rows, strata, key, cells(rows, strata), quota(holdout), seed).where(F.col("rank") <= F.col("_wanted")).select(key, F.lit("holdout").alias("_split"))
    return rows.join(held, key, "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_split")


def random_split(rows: DataFrame, key: str, holdout: int, seed: int = 0) -> DataFrame:
    held = shuffled_take(rows, key, holdout, seed).select(key, F.lit("holdout").alias("_split"))
    return rows.join(held, key, "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_split")


def stratified_sample(rows: DataFrame, category: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """max(1, n // categories) of each category, topped up from all others in seeded order, at most ``n`` in all."""
    sizes = cells(rows, [category])
    per = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("n_cells"))).cast("long")
    first = ranked(rows, [category], key, sizes, F.least(per, F.col("cell_rows")), seed).where(F.col("rank") <= F.col("_wanted"))
    first = first.select(*rows.columns, F.lit(0).alias("_pass"), F.col("cell").cast("long").alias("_cell"), "_o")
    rest = rows.join(first.select(key), key, "left_anti").withColumn("_o", order_key(F.col(key), seed=seed)).orderBy("_o", key).limit(n)
    rest = rest.select(*rows.columns, F.lit(1).alias("_pass"), F.lit(0).cast("long").alias("_cell"), "_o")
    return first.unionByName(rest).orderBy("_pass", "_cell", "_o", key).limit(n).drop("_pass", "_cell", "_o")


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of small dimensions."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(F.broadcast(axis))
    return out


def seeds_for_cells(cells_: DataFrame, skeletons: DataFrame, skeleton_key: str, n: int, seed: int = 0) -> DataFrame:
    """ceil(n / cells) draws with replacement of a skeleton for every cell, then seeded order and the first ``n``."""
    names = cells_.columns
    total = cells_.agg(F.count("*").alias("_cells"))
    pool = skeletons.withColumn("_pick", F.row_number().over(Window.orderBy(skeleton_key)) - 1)  # a small dimension
    size = pool.agg(F.count("*").alias("_pool"))
    drawn = cells_.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(size)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.ceil(F.lit(n) / F.col("_cells")).cast("int"))))
    o = order_key(*[F.col(c) for c in names], F.col("draw"), seed=seed)
    drawn = drawn.withColumn("_o", o).withColumn("_pick", F.pmod(F.conv(F.substring("_o", 1, 8), 16, 10).cast("long"), F.col("_pool")).cast("int"))
    return drawn.join(F.broadcast(pool), "_pick").orderBy("_o").limit(n).drop("_o", "_pick", "_cells", "_pool")


def unique_draws(candidates: DataFrame, key: list[str], n: int, order: str) -> DataFrame:
    """Rejection sampling: of candidates in ``order`` the first of each key, until ``n`` are found."""
    first = candidates.groupBy(*key).agg(F.min(order).alias(order))
    return candidates.join(first, [*key, order]).orderBy(order).limit(n)


def pick_distinct(values: Column, k: int, *parts: Column, seed: int = 0) -> Column:
    """``k`` different values of a short array in an order that the row's parts decide."""
    keyed = F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct(order_key(v, *parts, seed=seed).alias("o"), v.alias("v"))))
    return F.slice(F.transform(keyed, lambda s: s["v"]), 1, k)


def bootstrap_rows(rows: DataFrame, key: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, row): a resample with replacement of the size of ``rows`` for every draw, by hashed row numbers."""
    numbered = rows.withColumn("_at", F.row_number().over(Window.orderBy(key)) - 1)  # a report-sized table
    n = numbered.agg(F.count("*").alias("_n"))
    picks = numbered.select("_at").crossJoin(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    picks = picks.select("draw", F.pmod(F.xxhash64("draw", "_at", F.lit(seed)), F.col("_n")).cast("int").alias("_at"))
    return picks.join(numbered, "_at").drop("_at")
