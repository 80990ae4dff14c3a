import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import regular_grid as G


def dense(t, v, r, q):
    """The same posterior from one linear system over all states."""
    n = len(t)
    prec, right = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    prec[:2, :2] += np.diag([1e-4, 1e-2])
    right[:2] += np.diag([1e-4, 1e-2]) @ [v[0], 0]
    for k in range(n):
        prec[2 * k, 2 * k] += 1 / r[k]
        right[2 * k] += v[k] / r[k]
        if k:
            d = t[k] - t[k - 1]
            f = np.array([[1, d], [0, 1]])
            w = np.linalg.inv(q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]]))
            a, b = slice(2 * k - 2, 2 * k), slice(2 * k, 2 * k + 2)
            prec[a, a] += f.T @ w @ f
            prec[b, b] += w
            prec[a, b] -= f.T @ w
            prec[b, a] -= w @ f
    cov = np.linalg.inv(prec)
    x = cov @ right
    return x[::2], x[1::2], np.diag(cov)[::2]


def test_smoother_equals_the_linear_system():
    rng = np.random.default_rng(0)
    t = np.cumsum(rng.uniform(0.5, 4, 40))
    v, r = np.sin(t / 9) + rng.normal(0, 0.1, 40), rng.uniform(0.5, 1.5, 40)
    x, s, var = (a[0] for a in G.smooth(t[None], v[None], r[None], np.ones((1, 40), bool), 0.01))
    X, S, V = dense(t, v, r, 0.01)
    assert np.allclose(x, X, atol=1e-6) and np.allclose(s, S, atol=1e-6) and np.allclose(var, V, atol=1e-6)


def test_windows_agree_with_the_unbroken_smoother():
    rng = np.random.default_rng(1)
    n = 1500
    slot = np.cumsum(rng.choice([1, 1, 1, 2, 30], n))
    pdf = pd.DataFrame({"source": "a", "slot": slot, "level": np.sin(slot / 50) + rng.normal(0, 0.05, n), "t": 0.0, "n": 1})
    got = G.smooth_sources(pdf, 0.01)
    t = (slot - slot[0]).astype(float)
    x, s, _ = G.smooth(t[None], pdf["level"].to_numpy()[None], np.ones((1, n)), np.ones((1, n), bool), 0.01)
    assert np.abs(got["x"] - x[0]).max() < 1e-4 and np.abs(got["s"] - s[0]).max() < 1e-4


def instants(spark, rows):
    return spark.createDataFrame(rows, "source string, us long, value double, slot int, n int")


def test_grid_marks_and_fills_holes(spark):
    q = 900 * 10**6
    rows = [("a", k * q + 5 * 10**6, 1.0 + 0.1 * k, 0, 0) for k in (0, 1, 2, 6, 7)] + [("a", 1 * q + 7, 1.1, 0, 0)]
    rows += [("b", 3 * q, 2.0, 0, 0), ("c", None, 2.0, 0, 0), ("c", 0, None, 0, 0), ("c", 0, float("nan"), 0, 0), ("c", 0, 130.0, 0, 0), (None, 0, 1.0, 0, 0), ("c", 0, float("inf"), 0, 0)]
    slots = G.fill_slots(instants(spark, rows), "source", "us", "value", 900, 0.0, 125.0)
    grid = G.to_grid(G.smoothed_runs(slots, 900), 900).orderBy("source", "grid_ts").collect()
    a = [r for r in grid if r.source == "a"]
    assert [r.missing for r in a] == [False, False, False, True, True, True, False, False]
    assert np.allclose([r.value for r in a], [1 + 0.1 * k for k in range(8)], atol=0.03)
    assert all(r.sd >= 0 for r in a) and max(r.sd for r in a if r.missing) >= min(r.sd for r in a if not r.missing)
    assert [(r.source, r.missing, r.value) for r in grid if r.source != "a"] == [("b", False, 2.0)]


def test_holes_only_and_empty(spark):
    q = 900 * 10**6
    rows = [("a", 0, 1.0, 0, 0), ("a", 5 * q, 1.0, 0, 0)]
    slots = G.fill_slots(instants(spark, rows), "source", "us", "value", 900, 0.0, 125.0)
    assert [(r.slot, r.n_slots) for r in G.smoothed_runs(slots, 900, holes_only=True).collect()] == [(1, 4)]
    none = G.fill_slots(instants(spark, rows).limit(0), "source", "us", "value", 900, 0.0, 125.0)
    assert G.to_grid(G.smoothed_runs(none, 900), 900).count() == 0


def test_rates_are_fitted_to_each_source():
    rng = np.random.default_rng(2)
    n, made, levels = 6000, [0.004, 0.05, 0.5], []
    for q in made:
        x = s = 0.0
        out = np.empty(n)
        noise = rng.normal(0, 1, (n, 2)) @ np.linalg.cholesky(q * np.array([[1 / 3, 1 / 2], [1 / 2, 1]])).T
        for k in range(n):
            x, s = x + s + noise[k, 0], s + noise[k, 1]
            out[k] = x
        levels.append(out + rng.normal(0, 1, n))
    got = G.fitted_rates(np.tile(np.arange(n), 3), np.concatenate(levels), np.array([0, n, 2 * n]))
    assert np.all(np.abs(np.log(got / made)) < np.log([4, 1.8, 1.5]))
    assert G.fitted_rates(np.arange(10) * 3, np.arange(10.0), np.array([0])).tolist() == [G.RATE]
