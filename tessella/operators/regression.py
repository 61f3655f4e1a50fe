"""Small-sample regressions and resampling, one group (a domain, a primitive) a task.

A group is a table of model scores, tens of rows; the groups are dealt out by
Spark and solved with numpy in closed form, its rows in order of ``key`` so
that resamples are the same at every run.  Larger tables are to be aggregated
to such groups first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..joins import scratch

# The primitives that are taken to explain a domain, and its benchmark.
DOMAIN_PRIMITIVES = {
    "cybermetric": ("ToM", "Causal", "Strategic"), "medqa": ("Causal", "Moral", "Spatial"), "legalbench": ("Moral",), "truthfulqa": ("ToM", "Moral", "Strategic"),
    "finqa": ("ToM", "Causal", "Strategic"), "bb_diplomacy": (), "scienceqa": ("ToM", "Causal", "Spatial"),
}


def imputed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing values become the mean of their column; columns without any value go. Also which columns stay."""
    kept = ~np.all(np.isnan(x), axis=0)
    x = x[:, kept]
    return np.where(np.isnan(x), np.nanmean(x, axis=0) if x.size else 0.0, x), kept


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept, the latter without penalty."""
    mx, my = x.mean(axis=0), y.mean()
    xc = x - mx
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - my))
    return beta, float(my - mx @ beta)


def loo_r2(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, least: int = 5) -> float:
    """1 - sum of squared leave-one-out errors over the total; NaN with too few rows or a constant y."""
    n, total = len(y), float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0
    if n < least or not total or not x.shape[1]:
        return float("nan")
    beta, intercept = ridge(x, y, alpha)
    xc = x - x.mean(axis=0)
    # the diagonal of the hat matrix turns residuals into leave-one-out errors, without a fit for each row
    hat = 1 / n + (xc * np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T).T).sum(axis=1)
    return 1 - float((((y - x @ beta - intercept) / (1 - hat)) ** 2).sum()) / total


def null_if_nan(v: float) -> float | None:
    return None if v is None or np.isnan(v) else float(v)


def _number(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return rows[columns].to_numpy(dtype=float)


def ridge_by(rows: DataFrame, group: str, features: dict[str, list[str]], y: str, alpha: float = 1.0, least: int = 5, key: str | None = None) -> DataFrame:
    """(group, n, r2, betas): leave-one-out R2 and coefficients by name; ``features``: those of each group. Imputation sees all rows, also the one left out."""

    def fit(group_key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key) if key else part
        part = part[part[y].notna()]
        names = features.get(group_key[0], [])
        x, kept = imputed(_number(part, names)) if names else (np.empty((len(part), 0)), np.array([], dtype=bool))
        target = part[y].to_numpy(dtype=float)
        used = [n for n, k in zip(names, kept, strict=True) if k]
        score = loo_r2(x, target, alpha, least)
        betas = ridge(x, target, alpha)[0] if used and len(part) >= least else []
        return pd.DataFrame({group: [group_key[0]], "n": [len(part)], "r2": [null_if_nan(score)], "betas": [dict(zip(used, map(float, betas), strict=False))]})

    return rows.groupBy(group).applyInPandas(fit, f"{group} string, n long, r2 double, betas map<string,double>")


def sign_stability(rows: DataFrame, group: str, features: dict[str, list[str]], y: str, draws: int = 5000, seed: int = 42, alpha: float = 1.0, key: str | None = None) -> DataFrame:
    """(group, feature, p_positive, p_negative, verdict): how often a bootstrap coefficient has each sign. Every group draws with a generator of its own."""
    order = {g: k for k, g in enumerate(sorted(features))}

    def fit(group_key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key) if key else part
        part = part[part[y].notna()]
        names = features.get(group_key[0], [])
        out = []
        if names and len(part) >= 5:
            x, kept = imputed(_number(part, names))
            target, rng = part[y].to_numpy(dtype=float), np.random.default_rng([seed, order[group_key[0]]])
            used = [n for n, k in zip(names, kept, strict=True) if k]
            signs = np.zeros((2, len(used)))
            for _ in range(draws):
                at = rng.integers(0, len(target), len(target))
                beta, _ = ridge(x[at], target[at], alpha)
                signs += (beta > 0), (beta < 0)
            for k, name in enumerate(used):
                p = signs[0, k] / draws
                out.append((group_key[0], name, p, signs[1, k] / draws, "hit" if p >= 0.95 else "miss" if p <= 0.05 else "underpowered"))
        return pd.DataFrame(out, columns=[group, "feature", "p_positive", "p_negative", "verdict"])

    return rows.groupBy(group).applyInPandas(fit, f"{group} string, feature string, p_positive double, p_negative double, verdict string")


def bootstrap_interval(rows: DataFrame, group: str, statistic: Callable[[pd.DataFrame], float], draws: int = 2000, seed: int = 0, least_valid: int = 100, key: str | None = None) -> DataFrame:
    """(group, value, lo, hi): a statistic and its 95 % interval over resamples of the group's rows; null with too few valid draws."""

    def fit(group_key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key) if key else part
        part = part.reset_index(drop=True)
        rng = np.random.default_rng(seed)
        found = np.array([statistic(part.iloc[rng.integers(0, len(part), len(part))]) for _ in range(draws)], dtype=float)
        found = found[~np.isnan(found)]
        lo, hi = np.percentile(found, [2.5, 97.5]) if len(found) >= least_valid else (None, None)
        return pd.DataFrame({group: [group_key[0]], "value": [null_if_nan(statistic(part))], "lo": [lo], "hi": [hi]})

    return rows.groupBy(group).applyInPandas(fit, f"{group} string, value double, lo double, hi double")


def eta2_of(part: pd.DataFrame, group: str = "family", y: str = "ca") -> float:
    """The statistic for ``bootstrap_interval``: NaN with fewer than two groups or without variance."""
    values, at = part[y].to_numpy(dtype=float), np.unique(part[group].to_numpy(dtype=str), return_inverse=True)[1]
    mean = values.mean()
    total, sizes = ((values - mean) ** 2).sum(), np.bincount(at)
    if len(sizes) < 2 or not total:
        return float("nan")
    return float((sizes * (np.bincount(at, values) / sizes - mean) ** 2).sum() / total)


def slope_of(part: pd.DataFrame, x: str = "log_params", y: str = "ca") -> float:
    dx = part[x] - part[x].mean()
    return float((dx * part[y]).sum() / (dx**2).sum()) if part[x].nunique() > 1 else float("nan")


def within_slope_of(part: pd.DataFrame, group: str = "family", x: str = "log_params", y: str = "ca") -> float:
    inner = part[[x, y]] - part.groupby(group)[[x, y]].transform("mean")
    return float((inner[x] * inner[y]).sum() / (inner[x] ** 2).sum()) if (inner[x] ** 2).sum() > 1e-12 else float("nan")


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 20_000, tolerance: float = 1e-4) -> np.ndarray:
    """Coordinate descent on (1 / 2n) |y - xb|^2 + alpha |b| for centred data."""
    n, b = len(y), np.zeros(x.shape[1])
    scale, rest = (x**2).sum(axis=0) / n, y.copy()
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(scale):
            old, rho = b[j], x[:, j] @ rest / n + scale[j] * b[j]
            b[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / scale[j]
            if b[j] != old:
                rest += x[:, j] * (old - b[j])
                most = max(most, abs(b[j] - old))
        if most <= tolerance * max(1e-12, np.abs(b).max(initial=0)):
            break
    return b


def lasso_cv(x: np.ndarray, y: np.ndarray, folds: int = 5, steps: int = 100, ratio: float = 1e-3) -> tuple[np.ndarray, float]:
    """The penalty of least mean squared error over contiguous folds, and the coefficients with it."""
    xc, yc = x - x.mean(axis=0), y - y.mean()
    top = np.abs(xc.T @ yc).max() / len(y)
    if not top:
        return np.zeros(x.shape[1]), 0.0
    alphas = np.geomspace(top, top * ratio, steps)
    errors = np.zeros(steps)
    for test in np.array_split(np.arange(len(y)), folds):
        train = np.setdiff1d(np.arange(len(y)), test)
        mx, my = x[train].mean(axis=0), y[train].mean()
        for k, a in enumerate(alphas):
            b = lasso(x[train] - mx, y[train] - my, a)
            errors[k] += ((y[test] - my - (x[test] - mx) @ b) ** 2).mean()
    best = alphas[int(np.argmin(errors))]
    return lasso(xc, yc, best), float(best)


def pairwise_lasso(rows: DataFrame, group: str, primitives: list[str], y: str, least: int = 10, key: str | None = None) -> DataFrame:
    """(group, alpha, n_survivors, top): which products of two scores a cross-validated lasso keeps, the three largest first."""
    from itertools import combinations

    def fit(group_key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key) if key else part
        part = part[part[y].notna()]
        columns = [group, "alpha", "n_survivors", "top"]
        if len(part) < least:
            return pd.DataFrame(columns=columns)
        x, kept = imputed(_number(part, primitives))
        used = [p for p, k in zip(primitives, kept, strict=True) if k]
        pairs = list(combinations(range(len(used)), 2))
        products = np.column_stack([x[:, a] * x[:, b] for a, b in pairs])
        spread = products.std(axis=0)
        products = (products - products.mean(axis=0)) / np.where(spread > 0, spread, 1)
        b, alpha = lasso_cv(products, part[y].to_numpy(dtype=float))
        alive = sorted((-abs(c), f"{used[i]} x {used[j]}") for (i, j), c in zip(pairs, b, strict=True) if abs(c) > 1e-9)
        return pd.DataFrame([(group_key[0], alpha, len(alive), [name for _, name in alive[:3]])], columns=columns)

    return rows.groupBy(group).applyInPandas(fit, f"{group} string, alpha double, n_survivors long, top array<string>")


def linear_probe(vectors: DataFrame, label: str, features: str, fold: str, c: float = 1.0, iterations: int = 100) -> DataFrame:
    """Logistic regression on vectors: accuracy in the training and the held-out fold and the norm of the weights. Spark ML fits it; ``fold`` is true for training rows."""
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rows = vectors.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(fold).alias("train")).persist()
    train = rows.where("train")
    model = LogisticRegression(regParam=1.0 / (c * max(1, train.count())), maxIter=iterations, standardization=False).fit(train)
    # as read back it has no training summary, which holds the session and cannot be sent to tasks once the session has observed a metric
    path = scratch(vectors.sparkSession, "linear-probe")
    model.write().save(path)
    model = LogisticRegressionModel.load(path)
    norm = float(np.sqrt((model.coefficientMatrix.toArray() ** 2).sum()))
    scored = model.transform(rows)
    return scored.groupBy("train").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")).withColumn("weight_norm", F.lit(norm))
