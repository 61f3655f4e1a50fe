"""Regression and variance statistics of grouped observations, in SQL aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slope(y: str, x: str) -> Column:
    """OLS slope; null with fewer than two different x."""
    return F.when(F.min(x) < F.max(x), F.regr_slope(F.col(y), F.col(x)))


def ols(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """n, slope, intercept and R2 of y on x per group."""
    use = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    spread = F.min(x) < F.max(x)
    return use.groupBy(*by).agg(
        F.count("*").alias("n"), slope(y, x).alias("slope"), F.when(spread, F.regr_intercept(F.col(y), F.col(x))).alias("intercept"), F.when(spread, F.regr_r2(F.col(y), F.col(x))).alias("r2")
    )


def slopes(rows: DataFrame, by: list[str], x: str, ys: list[str], size: str | None = None, least_models: int = 3, least_sizes: int = 2) -> DataFrame:
    """The slope of several responses per group, for groups with enough rows and different sizes."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n_models"), F.count_distinct(size or x).alias("n_distinct_sizes"), *[slope(y, x).alias(f"{y}_slope") for y in ys])
    return found.where((F.col("n_models") >= least_models) & (F.col("n_distinct_sizes") >= least_sizes))


def compression_mode(target: Column, retain: Column, ca: Column) -> Column:
    return (
        F.when(target.isNull() | retain.isNull() | ca.isNull(), "insufficient")
        .when((target > 0) & (retain >= target) & (ca <= 0), "true_compression")
        .when((target > 0) & (ca > 0), "growth")
        .when((target <= 0) & (retain <= 0), "pseudo_compression")
        .otherwise("mixed")
    )


def eta_squared(rows: DataFrame, by: list[str], group: str, y: str) -> DataFrame:
    """Share of the variance of y between groups; null where y does not vary. Two aggregates: per group, then over groups."""
    per = rows.where(F.col(y).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    w = Window.partitionBy(*by)
    per = per.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    between = F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2)
    within = F.sum(F.col("n") * F.col("v"))
    return per.groupBy(*by).agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_groups"), F.when(between + within > 0, between / (between + within)).alias("eta2"))


def demeaned(rows: DataFrame, by: list[str], group: str, columns: list[str]) -> DataFrame:
    """Adds ``<column>_within``: the value less the mean of its group."""
    w = Window.partitionBy(*by, group)
    return rows.withColumns({f"{c}_within": F.col(c) - F.avg(c).over(w) for c in columns})


def eta_squared_given(rows: DataFrame, by: list[str], group: str, y: str, x: str) -> DataFrame:
    """What groups explain of y beyond x: (SSR(1, x) - SSR(1, x, groups)) / SST; 5 rows and 2 groups at least.

    The residual sum with group dummies is that of the values less their group
    means (Frisch-Waugh), so sums of squares suffice.
    """
    use = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    inner = demeaned(use, by, group, [y, x])

    def residual(a: str, b: str) -> Column:
        syy, sxx, sxy = F.regr_syy(F.col(a), F.col(b)), F.regr_sxx(F.col(a), F.col(b)), F.regr_sxy(F.col(a), F.col(b))
        return syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0))

    enough = (F.count("*") >= 5) & (F.count_distinct(group) >= 2)
    total = F.regr_syy(F.col(y), F.col(y))
    return inner.groupBy(*by).agg(F.when(enough & (total > 0), (residual(y, x) - residual(f"{y}_within", f"{x}_within")) / total).alias("eta2_given"))


def fixed_effect_slope(rows: DataFrame, by: list[str], group: str, y: str, x: str, size: str | None = None) -> DataFrame:
    """Slope of y on x within groups that have two or more sizes, and R2 against the grand mean; 4 rows and 2 groups at least."""
    sizes = Window.partitionBy(*by, group)
    kept = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumn("_sizes", F.size(F.collect_set(size or x).over(sizes))).where(F.col("_sizes") >= 2)
    inner = demeaned(kept, by, group, [y, x])
    enough = (F.count("*") >= 4) & (F.count_distinct(group) >= 2)
    b = F.regr_slope(F.col(f"{y}_within"), F.col(f"{x}_within"))
    syy, sxx, sxy = (f(F.col(f"{y}_within"), F.col(f"{x}_within")) for f in (F.regr_syy, F.regr_sxx, F.regr_sxy))
    total = F.regr_syy(F.col(y), F.col(y))
    r2 = 1 - F.try_divide(syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0)), total)
    return inner.groupBy(*by).agg(F.count("*").alias("n"), F.when(enough, b).alias("fe_slope"), F.when(enough & (total > 0), r2).alias("fe_r2"))


def pearson_pairs(long: DataFrame, unit: str, name: str, value: str, names: list[str], least: int = 3) -> DataFrame:
    """Pearson of every two measures over the units that have both; 0 where one does not vary; pairs with fewer than ``least`` units go."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(name))
    rows = long.where(F.col(value).isNotNull()).select(F.col(unit).alias("u"), F.col(name).alias("p"), order.alias("o"), F.col(value).alias("v")).where("o > 0")
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.u") == F.col("b.u")) & (F.col("a.o") < F.col("b.o")))
    found = pairs.groupBy(F.col("a.p").alias("a"), F.col("b.p").alias("b")).agg(F.count("*").alias("n"), F.corr("a.v", "b.v").alias("r"))
    return found.where(F.col("n") >= least).withColumn("r", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)))


def leave_one_out_correlation(wide: DataFrame, unit: str, x: str, y: str) -> DataFrame:
    """(dropped, n, r): the correlation without each unit in turn, from the sums less its own terms; and 'full'.

    A unit that lacks a value is dropped without effect.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    terms = {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "syy": F.col(y) * F.col(y), "sxy": F.col(x) * F.col(y)}
    own = wide.select(unit, *[F.when(both, t).otherwise(0.0).alias(f"o_{k}") for k, t in terms.items()])
    sums = own.agg(*[F.sum(f"o_{k}").alias(k) for k in terms])

    def r(n, sx, sy, sxx, syy, sxy) -> Column:
        return F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))

    less = [F.col(k) - F.col(f"o_{k}") for k in terms]
    dropped = own.crossJoin(F.broadcast(sums)).select(F.col(unit).cast("string").alias("dropped"), less[0].cast("long").alias("n"), r(*less).alias("r"))  # one row of sums
    return sums.select(F.lit("full").alias("dropped"), F.col("n").cast("long").alias("n"), r(*[F.col(k) for k in terms]).alias("r")).unionByName(dropped)


def mean_sd(rows: DataFrame, by: list[str], value: str, threshold: float = 0.10) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count_if(F.abs(F.col(value)) >= threshold).alias("n_over"))


def similarity_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    p = F.percentile(value, [0.25, 0.5, 0.75])
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p[1].alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), p[0].alias("q25"), p[2].alias("q75"))
