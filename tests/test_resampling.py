"""Statistics from moments against plain versions of them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import regression, resampling

SCHEMA = "g string, k long, family string, x double, y double, z double"


def rows_of(n=400, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        g, f = ("a", "a", "b")[k % 3], str(k % 7)
        x = rng.normal(2, 1)
        out.append((g, k, f, x, 0.5 * x + 0.3 * int(f) + rng.normal(0, 1) + (g == "b") * x, rng.normal()))
    return out


@pytest.fixture(scope="module")
def hashes(spark):
    """The hash of each key, as the operators take it."""
    return {r["id"]: r["h"] for r in spark.range(2000).select("id", F.xxhash64("id").alias("h")).collect()}


def drawn(hashes, keys, draws, seed=0):
    h = np.array([hashes[k] for k in keys]).view(np.uint64)
    return resampling.weights(h, np.arange(draws + 1), seed)


def test_weights_are_poisson(hashes):
    w = drawn(hashes, range(2000), 500)
    assert (w[:, 0] == 1).all()
    w = w[:, 1:]
    for k in range(6):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.07 and np.abs(np.corrcoef(w[:200])[np.triu_indices(200, 1)]).mean() < 0.05
    assert (drawn(hashes, range(50), 20, seed=1)[:, 1:] != drawn(hashes, range(50), 20)[:, 1:]).any()


@pytest.mark.parametrize(("cells", "held"), [(1 << 21, 1 << 23), (64, 100)])
def test_moments(spark, hashes, monkeypatch, cells, held):
    monkeypatch.setattr(resampling, "CELLS", cells)
    monkeypatch.setattr(resampling, "HELD", held)
    rows = [*rows_of(120), ("a", 500, "0", None, 1.0, 1.0), (None, 501, None, 2.0, 3.0, 4.0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r["g"], r["family"], r["draw"]): r["gram"] for r in resampling.moments(frame, ["g", "family"], ["x", "y"], F.col("k"), 30).collect()}
    for g, f in {(r[0], r[2]) for r in rows}:
        own = [r for r in rows if (r[0], r[2]) == (g, f) and r[3] is not None]
        w = drawn(hashes, [r[1] for r in own], 30)
        a = np.array([[1, r[3], r[4]] for r in own])
        for d in range(31):
            full = a.T @ (a * w[:, d : d + 1])
            assert got[g, f, d] == pytest.approx(list(full[np.triu_indices(3)]))
    assert len(got) == 31 * len({(r[0], r[2]) for r in rows})


def test_intervals_agree_with_resampled_rows(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, SCHEMA)
    rng = np.random.default_rng(0)
    slope = lambda x, y: ((x - x.mean()) * y).sum() / ((x - x.mean()) ** 2).sum()
    got = {r["g"]: r for r in resampling.interval(resampling.slope_draws(frame, ["g"], "x", "y", F.col("k"), 10_000), ["g"]).collect()}
    inner = {r["g"]: r for r in resampling.interval(resampling.slope_draws(frame, ["g"], "x", "y", F.col("k"), 2000, within="family"), ["g"]).collect()}
    etas = {r["g"]: r for r in resampling.interval(resampling.eta_draws(frame, ["g"], "family", "y", F.col("k"), 2000), ["g"]).collect()}

    def eta(f, y):
        total = ((y - y.mean()) ** 2).sum()
        return sum((f == v).sum() * (y[f == v].mean() - y.mean()) ** 2 for v in set(f)) / total

    def within(f, x, y):
        dummies = np.array([[float(v == u) for u in sorted(set(f))] for v in f])
        return np.linalg.lstsq(np.hstack([x[:, None], dummies]), y, rcond=None)[0][0]

    for g in "ab":
        x, y, f = (np.array([r[c] for r in rows if r[0] == g]) for c in (3, 4, 2))
        at = [rng.integers(0, len(x), len(x)) for _ in range(3000)]
        for found, whole, of in ((got, slope(x, y), lambda i: slope(x[i], y[i])), (etas, eta(f, y), lambda i: eta(f[i], y[i])), (inner, within(f, x, y), lambda i: within(f[i], x[i], y[i]))):
            plain = np.array([of(i) for i in at])
            lo, hi = np.percentile(plain, [2.5, 97.5])
            assert found[g]["value"] == pytest.approx(whole)
            # the ends of two samples of draws differ by a tenth of the spread
            assert abs(found[g]["lo"] - lo) < 0.25 * plain.std() and abs(found[g]["hi"] - hi) < 0.25 * plain.std()
    assert got["a"]["valid"] == 10_000


def test_too_little_for_a_statistic(spark):
    frame = spark.createDataFrame([("a", k, "0", 1.0, float(k), 0.0) for k in range(9)] + [("b", 1, None, 1.0, 1.0, 1.0), ("c", 2, "1", None, 1.0, 1.0)], SCHEMA)
    slopes = {r["g"]: (r["value"], r["lo"], r["valid"]) for r in resampling.interval(resampling.slope_draws(frame, ["g"], "x", "y", F.col("k"), 200), ["g"]).collect()}
    assert slopes == {"a": (None, None, 0), "b": (None, None, 0)}
    assert {r["value"] for r in resampling.eta_draws(frame, ["g"], "family", "y", F.col("k"), 3).collect()} == {None}
    empty = spark.createDataFrame([], SCHEMA)
    assert resampling.slope_draws(empty, ["g"], "x", "y", F.col("k"), 5).count() == 0
    assert resampling.sign_stability(empty, "g", ["x"], "y", F.col("k"), 5).count() == 0
    assert resampling.mixed_slope(empty, "g", "family", "x", "y", "z").count() == 0


def test_signs(spark, hashes):
    rows = [(*r[:3], None if r[1] % 11 == 0 else r[3], *r[4:]) for r in rows_of(90)]
    got = {(r["g"], r["feature"]): r for r in resampling.sign_stability(spark.createDataFrame(rows, SCHEMA), "g", ["x", "z"], "y", F.col("k"), draws=400).collect()}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        x, _ = regression.imputed(np.array([[r[3], r[5]] for r in own], dtype=float))
        y, w = np.array([r[4] for r in own]), drawn(hashes, [r[1] for r in own], 400, seed=42)
        betas = []
        for d in range(1, 401):
            at = np.repeat(np.arange(len(y)), w[:, d].astype(int))
            betas.append(regression.ridge(x[at], y[at])[0])
        for k, name in enumerate(("x", "z")):
            p = float((np.array(betas)[:, k] > 0).mean())
            r = got[g, name]
            assert r["p_positive"] == pytest.approx(p) and r["p_negative"] == pytest.approx(1 - p)
            assert r["verdict"] == ("hit" if p >= 0.95 else "miss" if p <= 0.05 else "underpowered")


@pytest.mark.parametrize("n", [25, 600])
def test_lasso_from_sums_is_that_of_the_rows(spark, n):
    rng = np.random.default_rng(n)
    p = rng.uniform(0, 1, (n, 4))
    y = 2 * p[:, 0] * p[:, 1] - 1.5 * p[:, 2] * p[:, 3] + rng.normal(0, 0.15, n)
    data = [("g", k, *map(float, p[k]), float(y[k])) for k in range(n)] + [("few", k, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(4)]
    frame = spark.createDataFrame(data, "g string, k long, a double, b double, c double, d double, y double").repartition(7)
    fold = F.floor(F.col("k") * 5 / n)
    got = resampling.interaction_lasso(frame, "g", ["a", "b", "c", "d"], "y", fold).collect()
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    x = np.column_stack([p[:, i] * p[:, j] for i, j in pairs])
    b, alpha = regression.lasso_cv((x - x.mean(axis=0)) / x.std(axis=0), y)
    alive = sorted((-abs(v), f"{'abcd'[i]} x {'abcd'[j]}") for v, (i, j) in zip(b, pairs, strict=True) if abs(v) > 1e-9)
    assert [(r["g"], r["n_survivors"], r["top"]) for r in got] == [("g", len(alive), [name for _, name in alive[:3]])]
    assert got[0]["alpha"] == pytest.approx(alpha)
    direct = resampling.lasso_from_gram(x.T @ x / n, x.T @ (y - y.mean()) / n, alpha)
    assert direct == pytest.approx(regression.lasso(x, y - y.mean(), alpha, tolerance=1e-10), abs=1e-6)


def likelihood(families, beta, psi, s):
    total = 0.0
    for x, y in families:
        a = np.column_stack([np.ones(len(x)), x])
        v = a @ psi @ a.T + s * np.eye(len(x))
        r = y - a @ beta
        total -= 0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r))
    return total


def climbed(families, start):
    """The likelihood's maximum by a pattern search over (beta, Cholesky factor of psi, log s)."""
    def value(t):
        low = np.array([[t[2], 0.0], [t[3], t[4]]])
        return likelihood(families, t[:2], low @ low.T, math.exp(t[5]))

    at, step, best = np.array(start), np.full(6, 0.3), value(start)
    while step.max() > 1e-7:
        for k in range(6):
            for sign in (1, -1):
                trial = at.copy()
                trial[k] += sign * step[k]
                if (v := value(trial)) > best:
                    at, best, step[k] = trial, v, step[k] * 1.5
                    break
            else:
                step[k] *= 0.5
    return at, best


def test_mixed_model_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(8)
    families, data = [], []
    for f in range(12):
        n = 4 + f
        x = rng.uniform(0, 3, n)
        u = rng.multivariate_normal([0, 0], [[0.5, 0.1], [0.1, 0.3]])
        y = 1 + u[0] + (0.7 + u[1]) * x + rng.normal(0, 0.4, n)
        families.append((x, y))
        data += [("p", f"f{f}", float(a), float(b), float(a)) for a, b in zip(x, y, strict=True)]
    data += [("p", "one size", 1.0, 9.0, 1.0)] * 3 + [("q", "f0", 1.0, 1.0, 1.0), ("q", "f0", 2.0, 1.0, 2.0)]
    got = {r["g"]: r for r in resampling.mixed_slope(spark.createDataFrame(data, "g string, family string, x double, y double, size double").repartition(5), "g", "family", "x", "y", "size").collect()}
    assert (got["q"]["slope"], got["q"]["n_families"]) == (None, 1) and got["p"]["n_families"] == 12
    sums = np.stack([(lambda a: a.T @ a)(np.column_stack([np.ones(len(x)), x, y])) for x, y in families])
    beta, covariance, psi, s = resampling.mixed_model(sums)
    best = max((climbed(families, start) for start in ([1, 0.7, 0.7, 0.1, 0.5, -2.0], [0, 0, 1, 0, 1, 0])), key=lambda t: t[1])
    assert likelihood(families, beta, psi, s) == pytest.approx(best[1], abs=1e-5)
    assert (got["p"]["slope"], got["p"]["se"]) == (pytest.approx(beta[1]), pytest.approx(math.sqrt(covariance[1, 1])))
    assert got["p"]["slope"] == pytest.approx(best[0][1], abs=2e-3)
