"""Resampling and regression from moments: no task ever holds a group.

A bootstrap draw gives every row a weight, Poisson with mean 1, that is a hash
of the row's key and the draw.  It needs no row numbers and no second look at
other rows, so each task adds up its own rows' weighted products for all draws
at once, and Spark adds the tasks' sums: a matrix of weighted products (a Gram
matrix) for each group and draw.  Slopes, shares of variance and penalised
regressions follow from these matrices alone.  Draw 0 has weight 1 everywhere
and gives the estimate itself.

The same sums by fold serve the cross-validated lasso, and by family the mixed
model with random slopes.

Rows with a null among the columns that a statistic needs take no part in it
(``imputed`` fills them first where means are wanted); groups may be null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import order_key

#: The distribution of a Poisson variable of mean 1 up to where 64 bits end.
POISSON = tuple(math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(20))
#: Weights that are held at once, and sums of all groups before they are handed on.
CELLS, HELD = 1 << 21, 1 << 23
GOLDEN, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all of them."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def weights(keys: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """A row for each of ``keys`` (64-bit hashes), a column for each of ``draws``; draw 0 is all ones."""
    bounds = np.array([min(int(p * 2.0**64), 2**64 - 1) for p in POISSON[:17]], dtype=np.uint64)
    of_draw = mixed((draws.astype(np.uint64) + np.uint64(seed << 32)) * GOLDEN + GOLDEN)
    found = np.searchsorted(bounds, mixed(keys[:, None] + of_draw), side="right").astype(float)
    found[:, draws == 0] = 1.0
    return found


def poisson_weight(*parts: Column, seed: int = 0) -> Column:
    """The same kind of weight as a column expression that any engine can recompute: from the first 32 bits of an MD5 hash."""
    u = F.conv(F.substring(order_key(*parts, seed=seed), 1, 8), 16, 10).cast("long")
    found = F.lit(0)
    for p in POISSON[:12]:
        found = found + (u >= F.lit(int(p * 2.0**32))).cast("int")
    return found


def entries(columns: list[str]) -> list[tuple[str, str]]:
    """What a row of ``moments`` holds: the sums of products of these pairs; ``1`` is the constant."""
    names = ["1", *columns]
    return [(a, b) for k, a in enumerate(names) for b in names[k:]]


def moments(rows: DataFrame, by: list[str], columns: list[str], key: Column | None = None, draws: int = 0, seed: int = 0) -> DataFrame:
    """(by, draw, gram): the weighted sums of ``entries(columns)`` for each group and draw, 0 being the unweighted one."""
    pairs = entries(columns)
    names = ["1", *columns]
    left, right = ([names.index(p[side]) for p in pairs] for side in (0, 1))
    number = np.arange(draws + 1)
    types = dict(rows.select(*by).dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for group, sums in held.items():
                some = [pa.array([v] * len(sums), batch.schema.field(k).type) for k, v in enumerate(group)]
                gram = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * len(pairs)), pa.array(sums.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*some, pa.array(number.astype(np.int32)), gram], [*by, "draw", "gram"])
            held.clear()

        batch = None
        for batch in batches:
            keys = batch.column(len(by)).to_numpy().view(np.uint64)
            values = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy() for c in batch.columns[len(by) + 1 :])])
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*(c.to_pylist() for c in batch.columns[: len(by)]), strict=True) if by else [()] * batch.num_rows):
                groups.setdefault(group, []).append(i)
            step = max(1, CELLS // len(number))
            for group, at in groups.items():
                if len(held) * len(number) * len(pairs) > HELD:
                    yield from handed_on()
                sums = held.setdefault(group, np.zeros((len(number), len(pairs))))
                for start in range(0, len(at), step):
                    some = at[start : start + step]
                    sums += weights(keys[some], number, seed).T @ (values[some][:, left] * values[some][:, right])
        if batch is not None:
            yield from handed_on()

    whole = rows.select(*by, F.xxhash64(F.lit(0) if key is None else key).alias("_key"), *[F.col(c).cast("double").alias(f"_{c}") for c in columns]).dropna(subset=[f"_{c}" for c in columns])
    schema = ", ".join([*(f"`{b}` {types[b]}" for b in by), "draw int, gram array<double>"])
    sums = [F.sum(F.col("gram")[i]) for i in range(len(pairs))]
    return whole.mapInArrow(partial, schema).groupBy(*by, "draw").agg(F.array(*sums).alias("gram"))


def entry(columns: list[str], a: str, b: str = "1") -> Column:
    pairs = entries(columns)
    return F.col("gram")[pairs.index((a, b)) if (a, b) in pairs else pairs.index((b, a))]


def interval(values: DataFrame, by: list[str], least_valid: int = 100) -> DataFrame:
    """(by, value, lo, hi, valid) of (by, draw, value): the estimate of draw 0 and the middle 95 % of the others; null with fewer than ``least_valid`` draws that have a value. A group has a row a draw here."""
    drawn = F.when(F.col("draw") > 0, F.col("value"))
    at = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    found = values.groupBy(*by).agg(F.max(F.when(F.col("draw") == 0, F.col("value"))).alias("value"), at.alias("_at"), F.count(drawn).alias("valid"))
    end = lambda k: F.when(F.col("valid") >= least_valid, F.col("_at")[k])
    return found.select(*by, "value", end(0).alias("lo"), end(1).alias("hi"), "valid")


def slope_draws(rows: DataFrame, by: list[str], x: str, y: str, key: Column, draws: int, within: str | None = None, seed: int = 0) -> DataFrame:
    """(by, draw, value): the slope of ``y`` on ``x``, or that inside the groups of ``within`` (fixed effects)."""
    m = moments(rows, [*by, within] if within else by, [x, y], key, draws, seed)
    w, sx, sy, sxx, sxy = (entry([x, y], *p) for p in (("1",), (x,), (y,), (x, x), (x, y)))
    parts = m.where(w > 0).select(*by, "draw", (sxy - sx * sy / w).alias("_xy"), (sxx - sx * sx / w).alias("_xx"), sxx.alias("_size"))
    sums = parts.groupBy(*by, "draw").agg(F.sum("_xy").alias("_xy"), F.sum("_xx").alias("_xx"), F.sum("_size").alias("_size"))
    return sums.select(*by, "draw", F.when(F.col("_xx") > 1e-12 * F.col("_size"), F.col("_xy") / F.col("_xx")).alias("value"))


def eta_draws(rows: DataFrame, by: list[str], family: str, y: str, key: Column, draws: int, seed: int = 0) -> DataFrame:
    """(by, draw, value): the share of the variance of ``y`` between families; null with fewer than two of them or without variance."""
    m = moments(rows, [*by, family], [y], key, draws, seed)
    w, sy, syy = entry([y], "1"), entry([y], y), entry([y], y, y)
    sums = m.where(w > 0).groupBy(*by, "draw").agg(F.count("*").alias("_n"), F.sum(w).alias("_w"), F.sum(sy).alias("_s"), F.sum(syy).alias("_ss"), F.sum(sy * sy / w).alias("_between"))
    middle = F.col("_s") * F.col("_s") / F.col("_w")
    total = F.col("_ss") - middle
    return sums.select(*by, "draw", F.when((F.col("_n") > 1) & (total > 1e-12 * F.col("_ss")), (F.col("_between") - middle) / total).alias("value"))


def imputed(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Nulls of ``columns`` become the mean of their group; a column without any value there becomes 0, which adds nothing."""
    means = rows.groupBy(*by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_mean_{c}") for c in columns])
    same = F.lit(True)
    for b in by:
        same = same & rows[b].eqNullSafe(means[b])
    joined = rows.join(means, same).drop(*[means[b] for b in by])
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}")) for c in columns}).drop(*[f"_mean_{c}" for c in columns])


def square(gram: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``entries`` of ``k`` columns as symmetric matrices."""
    out = np.zeros((len(gram), k + 1, k + 1))
    i, j = np.triu_indices(k + 1)
    out[:, i, j] = gram
    out[:, j, i] = gram
    return out


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of symmetric matrices (constant, features, response): sizes, means of all but the constant, and the sums of products around the means of features and of features with the response."""
    n = m[:, 0, 0]
    mean = m[:, 0, 1:] / n[:, None]
    around = m[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    return n, mean, around[:, :-1, :-1], around[:, :-1, -1]


def sign_stability(rows: DataFrame, by: str, features: list[str], y: str, key: Column, draws: int = 5000, alpha: float = 1.0, seed: int = 42, least: int = 5) -> DataFrame:
    """(by, feature, p_positive, p_negative, verdict): how often a ridge coefficient has each sign over the draws."""
    rows = imputed(rows.where(F.col(y).isNotNull()), [by], features)
    m = moments(rows, [by], [*features, y], key, draws, seed)
    kind = dict(rows.dtypes)[by]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part = part[[g[0] >= least for g in part["gram"]]]
            if part.empty:
                continue
            _, _, xx, xy = centred(square(np.stack(part["gram"]), len(features) + 1))
            beta = np.linalg.solve(xx + alpha * np.eye(len(features)), xy[:, :, None])[:, :, 0]
            yield pd.DataFrame({by: part[by].repeat(len(features)), "feature": features * len(part), "beta": beta.reshape(-1)})

    found = m.where("draw > 0").mapInPandas(solve, f"`{by}` {kind}, feature string, beta double").groupBy(by, "feature")
    shares = found.agg(F.avg((F.col("beta") > 0).cast("double")).alias("p_positive"), F.avg((F.col("beta") < 0).cast("double")).alias("p_negative"))
    p = F.col("p_positive")
    return shares.withColumn("verdict", F.when(p >= 0.95, "hit").when(p <= 0.05, "miss").otherwise("underpowered"))


def lasso_from_gram(g: np.ndarray, c: np.ndarray, alpha: float, start: np.ndarray | None = None, rounds: int = 5000, tolerance: float = 1e-7) -> np.ndarray:
    """Coordinate descent on b'gb / 2 - c'b + alpha |b| by covariance updates: the gradient is kept, not the residuals."""
    b = np.zeros(len(c)) if start is None else start.copy()
    gradient = c - g @ b
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(np.diag(g) > 0):
            rho = gradient[j] + g[j, j] * b[j]
            new = math.copysign(max(abs(rho) - alpha, 0.0), rho) / g[j, j]
            if new != b[j]:
                gradient -= g[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]))
                b[j] = new
        if most <= tolerance * max(1e-12, np.abs(b).max(initial=0)):
            break
    return b


def lasso_cv_from_gram(folds: np.ndarray, steps: int = 100, ratio: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coefficients and the penalty of least mean squared error, from one matrix of sums (constant, features, response) for each fold."""
    total = folds.sum(axis=0, keepdims=True)
    n, _, xx, xy = (x[0] for x in centred(total))
    top = np.abs(xy).max(initial=0) / n
    if not top:
        return np.zeros(len(xy)), 0.0
    alphas, errors = np.geomspace(top, top * ratio, steps), np.zeros(steps)
    for fold in folds:
        if not fold[0, 0] or fold[0, 0] == n:
            continue
        size, mean, a, c = (x[0] for x in centred(total - fold))
        b = None
        for k, alpha in enumerate(alphas):
            b = lasso_from_gram(a / size, c / size, alpha, b)
            # the response less its prediction is a linear form of (constant, features, response)
            form = np.concatenate([[mean[:-1] @ b - mean[-1]], -b, [1.0]])
            errors[k] += form @ fold @ form / fold[0, 0]
    best = float(alphas[int(np.argmin(errors))])
    return lasso_from_gram(xx / n, xy / n, best), best


def interaction_lasso(rows: DataFrame, by: str, primitives: list[str], y: str, fold: Column, least: int = 10) -> DataFrame:
    """(by, alpha, n_survivors, top): which products of two scores a cross-validated lasso keeps, the three largest first.

    Means and spreads of the products come from one aggregate, and the sums of
    standardised products by ``fold`` from another; what is solved is a matrix
    for each fold, whatever the number of rows.
    """
    pairs = list(combinations(primitives, 2))
    names = [f"p{k}" for k in range(len(pairs))]
    rows = imputed(rows.where(F.col(y).isNotNull()), [by], primitives).withColumn("_fold", fold)
    rows = rows.select(by, "_fold", F.col(y).cast("double").alias("_y"), *[(F.col(a) * F.col(b)).alias(p) for p, (a, b) in zip(names, pairs, strict=True)])
    spread = rows.groupBy(by).agg(*[f(p).alias(f"{kind}_{p}") for p in names for kind, f in (("mean", F.avg), ("sd", F.stddev_pop))], F.avg("_y").alias("mean_y"))
    scaled = rows.join(spread, rows[by].eqNullSafe(spread[by])).drop(spread[by])
    # a spread of rounding errors only is none
    sd = lambda p: F.when(F.col(f"sd_{p}") > 1e-12 * F.abs(F.col(f"mean_{p}")), F.col(f"sd_{p}"))
    scaled = scaled.select(by, "_fold", *[F.coalesce((F.col(p) - F.col(f"mean_{p}")) / sd(p), F.lit(0.0)).alias(p) for p in names], (F.col("_y") - F.col("mean_y")).alias("_y"))
    m = moments(scaled, [by, "_fold"], [*names, "_y"]).groupBy(by).agg(F.collect_list("gram").alias("grams"))  # a matrix a fold
    kind = dict(rows.dtypes)[by]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for group, grams in zip(part[by], part["grams"], strict=True):
                folds = square(np.stack(sorted(map(tuple, grams))), len(names) + 1)
                if folds[:, 0, 0].sum() < least:
                    continue
                b, alpha = lasso_cv_from_gram(folds)
                alive = sorted((-abs(v), f"{x} x {z}") for v, (x, z) in zip(b, pairs, strict=True) if abs(v) > 1e-9)
                out.append((group, alpha, len(alive), [name for _, name in alive[:3]]))
            yield pd.DataFrame(out, columns=[by, "alpha", "n_survivors", "top"])

    return m.mapInPandas(solve, f"`{by}` {kind}, alpha double, n_survivors long, top array<string>")


def mixed_model(sums: np.ndarray, rounds: int = 5000, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The likelihood maximum of y = X (beta + u) + e, X = (1, x), u of each family normal with covariance psi and e with variance s: (beta, its covariance, psi, s).

    ``sums`` has for each family the matrix of (constant, x, y).  Expectation
    of u given the present parameters, then their maximisation; beta is that of
    generalised least squares at each round.
    """
    n, xx, xy, yy = sums[:, 0, 0], sums[:, :2, :2], sums[:, :2, 2], sums[:, 2, 2]
    beta = np.linalg.lstsq(xx.sum(axis=0), xy.sum(axis=0), rcond=None)[0]
    s = float((yy.sum() - 2 * beta @ xy.sum(axis=0) + beta @ xx.sum(axis=0) @ beta) / n.sum()) or 1e-12
    psi = np.eye(2) * s / 2
    before = -math.inf
    for _ in range(rounds):
        core = np.linalg.inv(np.eye(2) * s + xx @ psi)  # X'V^-1 is this times X', V being the covariance of a family
        g = core @ xx  # X'V^-1X
        c = np.einsum("fij,fj->fi", core, xy)
        covariance = np.linalg.inv(g.sum(axis=0))
        beta = covariance @ c.sum(axis=0)
        r = xy - xx @ beta
        u = np.einsum("ij,fj->fi", psi, np.einsum("fij,fj->fi", core, r))
        spread = psi - psi @ g @ psi
        squares = yy - 2 * xy @ beta + np.einsum("i,fij,j->f", beta, xx, beta)
        likelihood = -0.5 * float((n * math.log(2 * math.pi * s)).sum() + np.linalg.slogdet(np.eye(2) + xx @ psi / s)[1].sum() + ((squares - np.einsum("fi,fi->f", r, u)) / s).sum())
        if likelihood - before <= tolerance * abs(likelihood):
            break
        before = likelihood
        left = squares - 2 * np.einsum("fi,fi->f", r, u) + np.einsum("fi,fij,fj->f", u, xx, u) + np.einsum("fij,fji->f", xx, spread)
        s = max(float(left.sum() / n.sum()), 1e-300)
        psi = (np.einsum("fi,fj->ij", u, u) + spread.sum(axis=0)) / len(n)
    return beta, covariance, psi, s


def mixed_slope(rows: DataFrame, by: str, family: str, x: str, y: str, size: str, least_families: int = 3, least_rows: int = 6) -> DataFrame:
    """(by, slope, se, n_families): the fixed slope of ``y`` on ``x`` with random intercepts and slopes by family, by maximum likelihood over families of two sizes and more; nulls where there are too few.

    A family is the sums of its products; what is solved has a matrix for each
    family, whatever the number of rows.
    """
    kind = dict(rows.dtypes)[by]
    several = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, family).agg(F.min(size).alias("_least"), F.max(size).alias("_most")).where("_least < _most").select(by, family)
    m = moments(rows, [by, family], [x, y])
    same = m[by].eqNullSafe(several[by]) & m[family].eqNullSafe(several[family])
    grams = m.join(several, same, "left_semi").groupBy(by).agg(F.collect_list("gram").alias("grams"))
    groups = rows.select(by).distinct()
    every = groups.join(grams, groups[by].eqNullSafe(grams[by]), "left").select(groups[by], "grams")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for group, found in zip(part[by], part["grams"], strict=True):
                sums = square(np.stack(sorted(map(tuple, found))), 2) if found is not None else np.zeros((0, 3, 3))
                if len(sums) < least_families or sums[:, 0, 0].sum() < least_rows:
                    out.append((group, None, None, len(sums)))
                    continue
                beta, covariance, _, _ = mixed_model(sums)
                out.append((group, float(beta[1]), math.sqrt(covariance[1, 1]), len(sums)))
            yield pd.DataFrame(out, columns=[by, "slope", "se", "n_families"])

    return every.mapInPandas(solve, f"`{by}` {kind}, slope double, se double, n_families long")
