"""Ridge models from summed moments against fits on the raw rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import crossval as V
from tidemark.operators import places

MODELS = [V.Model("season", (V.Block(((0, 2),)),)), V.Model("mixed", (V.Block(((0, 2),)), V.Block(((2, 4), (6, 14)), 0, 0.5))), V.Model("pca", (V.Block(((0, 14),), 3),))]


def table(spark, n=90, d=14, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 20, d) + rng.normal(size=d) * 50
    x[:, 3] = 7.0  # never varies
    y = x[:, 0] * 0.3 - x[:, 8] * 0.1 + rng.normal(size=n)
    y[::17] = np.nan
    roles = [["test" if k * 3 // n == f else "purged" if abs(k - (k * 3 // n > f) * (f + 1) * n / 3 - (k * 3 // n < f) * f * n / 3) < 2 else "train" for f in range(3)] for k in range(n)]
    rows = [(k, x[k].tolist(), float(y[k]), None if np.isnan(y[k]) else float(-y[k]), roles[k]) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, x array<double>, y double, z double, roles array<string>").repartition(4), x, y, np.array(roles)


def features(model, xt, xv):
    m, s = xt.mean(0), xt.std(0)
    s = np.where(s > 0, s, 1)
    out = []
    for b in model.blocks:
        c = np.concatenate([np.arange(*sp) for sp in b.spans])
        t, v = ((q[:, c] - m[c]) / s[c] for q in (xt, xv))
        if b.pca:
            basis = np.linalg.svd(t, full_matrices=False)[2][: b.pca].T
            t, v = t @ basis, v @ basis
        out.append((t * b.weight, v * b.weight))
    return [np.hstack(q) for q in zip(*out)]


def solved(x, y, xv, alpha):
    m = x.mean(0)
    return y.mean() + (xv - m) @ np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))


def by_blocks(x, y, alphas):
    cuts = [len(y) * k // 5 for k in range(6)]
    sse = [sum(((solved(np.delete(x, np.s_[max(0, a - 5) : b + 5], 0), np.delete(y, np.s_[max(0, a - 5) : b + 5]), x[a:b], al) - y[a:b]) ** 2).sum() for a, b in zip(cuts, cuts[1:])) for al in alphas]
    return alphas[int(np.argmin(sse))]


def by_single_rows(x, y, alphas):
    keep = lambda i: np.arange(len(y)) != i
    sse = [sum((solved(x[keep(i)], y[keep(i)], x[[i]], al)[0] - y[i]) ** 2 for i in range(len(y))) for al in alphas]
    return alphas[int(np.argmin(sse))]


@pytest.mark.parametrize("choose, brute", [("blocked", by_blocks), ("loo", by_single_rows)])
def test_predictions_equal_fits_on_the_rows(spark, choose, brute):
    df, x, y, roles = table(spark)
    alphas = [0.1, 1.0, 10.0, 100.0]
    got = {(r.target, r.model, r.f, r.row_id): (r.p, r.alpha) for r in V.ridge_predictions(df, "id", ["id"], ["y", "z"], MODELS, 3, alphas, choose).collect()}
    want = 0
    for f in range(3):
        train, test = (np.nonzero((roles[:, f] == role) & ~np.isnan(y))[0] for role in ("train", "test"))
        for model in MODELS:
            xt, xv = features(model, x[train], x[test])
            alpha = brute(xt, y[train], alphas)
            for k, p in zip(test, solved(xt, y[train], xv, alpha)):
                want += 1
                assert got["y", model.name, f, k] == pytest.approx((p, alpha), rel=1e-6)
                assert got["z", model.name, f, k][0] == pytest.approx(-p, rel=1e-6)
    assert len(got) == 2 * want


def test_too_few_rows_make_no_model(spark):
    df, *_ = table(spark, 18)
    assert V.ridge_predictions(df, "id", ["id"], ["y"], MODELS, 3).count() == 0
    assert V.ridge_predictions(df.limit(0), "id", ["id"], ["y"], MODELS, 0).count() == 0
    one = spark.createDataFrame([("a", k) for k in range(30)], "st string, k int")
    assert V.group_folds(one, "st", 2).count() == 0 and V.group_folds(one, "st").count() == 30


def test_the_registry_weighs_wide_blocks_down():
    widths = {"season": 2, "stats": 3, "stats_n": 3, "emb": 12, "emb_n": 12, "stats_ctx": 6, "emb_ctx": 24}
    models = {m.name: m for m in V.registry(widths)}
    assert len(models) == 15 and {m.matched for m in models.values()} <= {None, *models}
    wide = models["season + emb ridge [norm]"].blocks[1]
    assert wide.spans == ((20, 32),) and wide.weight == pytest.approx((3 / 12) ** 0.5)
    assert models["season + emb ridge + ctx [norm]"].blocks[1].weight == pytest.approx((9 / 36) ** 0.5)


def test_places_and_running_totals(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 331).alias("v"), (F.col("id") % 5).alias("w")).repartition(7)
    got = places.numbered(rows, ["v"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000)) and [r.v for r in got] == sorted(r.v for r in got)
    sums = places.running_total(rows, ["v"], "w", "upto").orderBy("upto", "v").collect()
    assert max(r.upto for r in sums) == sum(r.w for r in sums)
    assert places.numbered(rows.limit(0), ["v"]).count() == 0
