"""Vector expressions over array columns, and grouped means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though ``use`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(d: Column, least: float = 1e-8) -> Column:
    return let(F.struct(d.alias("d"), F.greatest(norm(d), F.lit(least)).alias("n")), lambda s: F.transform(s["d"], lambda x: x / s["n"]))


def project_out(h: Column, d: Column) -> Column:
    """``h`` without its part along ``d``."""
    with_unit = lambda s: let(F.struct(s["h"].alias("h"), s["u"].alias("u"), dot(s["h"], s["u"]).alias("along")), lambda t: F.zip_with(t["h"], t["u"], lambda x, y: x - t["along"] * y))
    return let(F.struct(h.alias("h"), unit(d).alias("u")), with_unit)


def pool_mean(rows: Column) -> Column:
    """The mean over an array of vectors."""
    n = F.size(rows)
    total = F.aggregate(F.slice(rows, 2, F.greatest(n - 1, F.lit(0))), F.try_element_at(rows, F.lit(1)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return let(F.struct(total.alias("t"), n.alias("n")), lambda s: F.transform(s["t"], lambda x: x / s["n"]))


def pool_last(rows: Column) -> Column:
    return F.try_element_at(rows, F.lit(-1))


def pool_mean_last(rows: Column, k: int) -> Column:
    return pool_mean(F.slice(rows, F.greatest(F.size(rows) - k + 1, F.lit(1)), F.lit(k)))


def random_direction(size: int, seed: int, length: float = 1.0) -> Column:
    """A direction that depends on the seed alone, scaled to ``length``: sums of hashed uniforms, close to normal."""
    uniform = lambda i, k: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(1 << 24)) / F.lit(float(1 << 24)) - 0.5
    raw = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: sum((uniform(i, k) for k in range(1, 12)), uniform(i, 0)))
    return let(raw, lambda r: F.transform(unit(r), lambda x: x * F.lit(length)))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): the mean vector of each group; partial sums are made before the shuffle, one row per group and position."""
    parts = rows.select(group, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
