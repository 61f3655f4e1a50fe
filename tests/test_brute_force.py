"""Queries that no SQL expresses, against plain versions on the same tables."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessella.plans import analysis, curation

ALPHA = 1.0


@pytest.fixture(scope="module")
def segments(spark, sf):
    """Of each segment its nations' rows in order."""
    found = defaultdict(list)
    for r in sorted(analysis.nation_scores(spark, sf).collect(), key=lambda r: r["model"]):
        found[r["primitive"]].append(r.asDict())
    assert len(found) == 5 and all(5 <= len(rows) <= 25 for rows in found.values())
    return found


def column(rows, *names):
    return np.array([[float(r[n]) for n in names] for r in rows])


def refit(x, y):
    """Ridge with a free intercept, by stacked least squares."""
    n, k = x.shape
    a = np.vstack([np.hstack([np.ones((n, 1)), x]), np.hstack([np.zeros((k, 1)), math.sqrt(ALPHA) * np.eye(k)])])
    return np.linalg.lstsq(a, np.concatenate([y, np.zeros(k)]), rcond=None)[0]


def left_out(x, y):
    errors = 0.0
    for i in range(len(y)):
        b = refit(np.delete(x, i, 0), np.delete(y, i))
        errors += (y[i] - b[0] - x[i] @ b[1:]) ** 2
    return 1 - errors / ((y - y.mean()) ** 2).sum()


def test_ridge(spark, sf, segments):
    for r in analysis.ridge_loo(spark, sf).collect():
        rows = segments[r["primitive"]]
        x, y = column(rows, "other", "log_params"), column(rows, "ca")[:, 0]
        assert (r["n"], r["r2"], r["beta"]) == (len(rows), pytest.approx(left_out(x, y), abs=2e-6), pytest.approx(refit(x, y)[2], abs=2e-6))
    for r in analysis.ridge_delta(spark, sf).collect():
        rows = segments[r["primitive"]]
        y = column(rows, "ca")[:, 0]
        assert r["delta"] == pytest.approx(left_out(column(rows, "log_params", "retain"), y) - left_out(column(rows, "log_params"), y), abs=4e-6)


def test_sign_stability(spark, sf, segments):
    got = {(r["primitive"], r["feature"]): (r["p_positive"], r["p_negative"], r["verdict"]) for r in analysis.sign_stability(spark, sf).collect()}
    assert len(got) == 10
    for k, (segment, rows) in enumerate(sorted(segments.items())):
        x, y, rng = column(rows, "other", "log_params"), column(rows, "ca")[:, 0], np.random.default_rng([42, k])
        counts = np.zeros((2, 2))
        for _ in range(5000):
            at = rng.integers(0, len(y), len(y))
            b = refit(x[at], y[at])[1:]
            counts += np.array([b > 0, b < 0])
        for j, name in enumerate(("other", "log_params")):
            p = counts[0, j] / 5000
            found = got[segment, name]
            assert found[:2] == (pytest.approx(p, abs=1e-3), pytest.approx(counts[1, j] / 5000, abs=1e-3))
            assert found[2] == ("hit" if found[0] >= 0.95 else "miss" if found[0] <= 0.05 else "underpowered")


def eta2(groups, y):
    total = sum((v - y.mean()) ** 2 for v in y)
    between = sum(len(own) * (np.mean(own) - y.mean()) ** 2 for g in set(groups) for own in [[v for h, v in zip(groups, y, strict=True) if h == g]])
    return between / total if total and len(set(groups)) > 1 else math.nan


def slope(x, y):
    return np.polyfit(x, y, 1)[0] if len(set(x)) > 1 else math.nan


def test_intervals(spark, sf, segments):
    for r in analysis.eta_bootstrap(spark, sf).collect():
        rows = segments[r["primitive"]]
        groups, y, rng = np.array([x["family"] for x in rows]), column(rows, "ca")[:, 0], np.random.default_rng(0)
        draws = [eta2(groups[at], y[at]) for at in (rng.integers(0, len(y), len(y)) for _ in range(2000))]
        lo, hi = np.nanpercentile(draws, [2.5, 97.5])
        assert (r["value"], r["lo"], r["hi"]) == (pytest.approx(eta2(groups, y)), pytest.approx(lo), pytest.approx(hi))
    got = {(r["primitive"], r["kind"]): r for r in analysis.slope_bootstrap(spark, sf).collect()}
    for segment, rows in segments.items():
        x, y, rng = column(rows, "log_params")[:, 0], column(rows, "ca")[:, 0], np.random.default_rng(0)
        draws = [slope(x[at], y[at]) for at in (rng.integers(0, len(y), len(y)) for _ in range(1000))]
        r = got[segment, "pooled"]
        assert (r["value"], r["lo"], r["hi"]) == (pytest.approx(slope(x, y)), *map(pytest.approx, np.nanpercentile(draws, [2.5, 97.5])))
        dummies = np.array([[float(g["family"] == f) for f in "01234"] for g in rows])
        assert got[segment, "within"]["value"] == pytest.approx(np.linalg.lstsq(np.hstack([column(rows, "log_params"), dummies]), y, rcond=None)[0][0])


def test_lasso_meets_its_optimality_conditions(spark, sf, segments):
    for r in analysis.pairwise_lasso(spark, sf).collect():
        rows = segments[r["primitive"]]
        t, s, p, y = column(rows, "target", "retain", "log_params", "ca").T
        names = ("target x retain", "target x log_params", "retain x log_params")
        x = np.column_stack([t * s, t * p, s * p])
        x, y = (x - x.mean(axis=0)) / x.std(axis=0), y - y.mean()
        best, b = math.inf, np.zeros(3)
        for signs in np.ndindex(3, 3, 3):  # every pattern of signs has its own closed form
            sign = np.array(signs) - 1.0
            on = sign != 0
            try:
                part = np.linalg.solve(x[:, on].T @ x[:, on] / len(y), x[:, on].T @ y / len(y) - r["alpha"] * sign[on]) if on.any() else np.zeros(0)
            except np.linalg.LinAlgError:
                continue
            trial = np.zeros(3)
            trial[on] = part
            loss = ((y - x @ trial) ** 2).sum() / 2 / len(y) + r["alpha"] * np.abs(trial).sum()
            best, b = (loss, trial) if loss < best - 1e-15 else (best, b)
        alive = sorted((-abs(v), n) for v, n in zip(b, names, strict=True) if abs(v) > 1e-6 * np.abs(b).max(initial=0) and v)
        assert r["alpha"] > 0 and abs(r["n_survivors"] - len(alive)) <= (1 if alive and abs(alive[-1][0]) < 0.02 * abs(alive[0][0]) else 0)
        assert not alive or r["top"][0] == alive[0][1] or abs(alive[0][0]) - abs(alive[1][0]) < 0.02 * abs(alive[0][0])


def spark_hash(*numbers):
    """XXH64 of 32-bit integers one after the other, as a signed long."""
    h = 42
    for x in numbers:
        h = xxhash.xxh64_intdigest(int(x).to_bytes(4, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def test_hashed_draws(spark, sf):
    for r in analysis.bootstrap_means(spark, sf).collect():
        keys = [spark_hash(r["draw"], k, 0) % 25 for k in range(25)]
        assert (r["sum"], r["different"]) == (sum(keys), len(set(keys)))
    raw = np.array([sum(spark_hash(i, 5, k) % (1 << 24) / (1 << 24) - 0.5 for k in range(12)) for i in range(1, 17)])
    found = analysis.random_direction_values(spark, sf).collect()
    assert len(found) == 10 and all(np.allclose(r["direction"], raw / np.linalg.norm(raw) * 2.5) for r in found)


def test_linear_probe(spark, sf):
    """Newton's method on the same penalised likelihood."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, y = np.array([r["embedding"] for r in rows], dtype=float), np.array([r["label"] < 5 for r in rows], dtype=float)
    train = np.array([r["vec_id"] % 5 > 0 for r in rows])
    a, t = np.hstack([x[train], np.ones((train.sum(), 1))]), y[train]
    w, penalty = np.zeros(a.shape[1]), np.append(np.ones(x.shape[1]), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (p - t) + penalty * w)
    got = {r["train"]: r for r in analysis.linear_probe_scores(spark, sf).collect()}
    right = (np.hstack([x, np.ones((len(x), 1))]) @ w > 0) == y
    for fold in (True, False):
        assert got[fold]["n"] == (train == fold).sum() and got[fold]["accuracy"] == pytest.approx(right[train == fold].mean(), abs=1.01 / (train == fold).sum())
        assert got[fold]["weight_norm"] == pytest.approx(np.linalg.norm(w[:-1]), rel=2e-2)


def test_linear_probe_after_an_observation(spark, sf):
    """A session that has observed a metric still fits and applies probes."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).count()
    assert seen.get["n"] == 5
    assert analysis.linear_probe_scores(spark, sf).count() == 2


def test_overlap_checks(spark, sf):
    turns = defaultdict(dict)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        if r["turn"] in (0, 1):
            turns[r["conv_id"]][r["turn"]] = r["text"]
    stop = {"the", "a", "an", "in", "on", "at", "to", "of", "for", "and", "or", "with"}
    vague = {"the", "for", "and", "with", "from", "over", "that", "this", "into", "onto", "about", "using"}
    got = {r["conv_id"]: (r["strict"], r["fuzzy"], r["concept"]) for r in curation.overlap_checks(spark, sf).collect()}
    assert set(got) == {c for c, t in turns.items() if t.get(0) is not None and t.get(1) is not None}
    for conv, found in got.items():
        t, r = turns[conv][0].lower(), turns[conv][1].lower()
        entities = turns[conv][0].split()[:5]
        named = [e.lower() for e in entities if e.lower() in t]

        def kept(e, r=r):
            own = [w for w in e.split() if w not in stop]
            return e in r or not own or sum(w in r for w in own) >= 0.5 * len(own)

        used = [w for w in re.split(r"[\s,/\-]+", " ".join(entities).lower()) if len(w) > 3 and w not in vague and w in t]
        assert found == (all(e in r for e in named), len(named) < 3 or sum(map(kept, named)) >= 0.34 * len(named), not used or any(w in r for w in used))
