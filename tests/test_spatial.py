import numpy as np
import pytest

from tidemark.operators import spatial as S


def points(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id string, lat double, lon double" + extra)


def brute(rows, radius):
    ok = [(k, a, b) for k, a, b in rows if k is not None and a is not None and b is not None and not np.isnan([a, b]).any() and (a, b) != (0, 0) and abs(a) <= 90]
    out = set()
    for i, (k, a, b) in enumerate(ok):
        for q, c, d in ok[i + 1 :]:
            if k != q and S.sphere_m(a, b, c, d) < radius:
                out.add((min(k, q), max(k, q)))
    return out


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    low = rng.random((500, 2))
    boxes = np.column_stack([low, low + 0.05 * rng.random((500, 2))])
    q, e = S.RTree(boxes).probe(boxes[:50])
    want = {(i, j) for i in range(50) for j in range(500) if (boxes[j, :2] <= boxes[i, 2:]).all() and (boxes[j, 2:] >= boxes[i, :2]).all()}
    assert set(zip(q.tolist(), e.tolist())) == want
    assert len(S.RTree(np.zeros((0, 4))).probe(boxes[:3])[0]) == 0


@pytest.mark.parametrize("rows_per_leaf", [20, 8000])
def test_near_pairs_agree_with_all_pairs(spark, monkeypatch, rows_per_leaf):
    monkeypatch.setattr(S, "ROWS_PER_LEAF", rows_per_leaf)
    rng = np.random.default_rng(1)
    rows = [(f"{i:03d}", float(53 + 0.01 * rng.random()), float(-8 + 0.01 * rng.random())) for i in range(300)]
    rows += [(f"c{i}", 53.001, -8.001) for i in range(12)]  # copies
    rows += [("w1", 10.0, 179.99995), ("w2", 10.0, -179.99995), ("n1", 89.99999, 10.0), ("n2", 89.99999, -170.0)]
    rows += [("x", None, 1.0), ("y", float("nan"), 1.0), ("z", 0.0, 0.0), ("z2", 0.0, 0.0), (None, 53.001, -8.001), ("big", 123.0, 4.0)]
    rows += rows[:5]
    got = {tuple(r) for r in S.near_pairs(points(spark, rows), "id", "lat", "lon", 60.0).collect()}
    assert got == brute(rows, 60.0)
    assert ("w1", "w2") in got


def test_regions_with_holes_and_bad_shapes(spark):
    square = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]]
    rings = [[{"x": float(x), "y": float(y)} for x, y in r] for r in square]
    regions = spark.createDataFrame([("a", rings), ("b", [rings[1]]), ("none", None), ("line", [rings[0][:2]]), (None, rings)], "rid string, rings array<array<struct<x: double, y: double>>>")
    rows = [("in", 2.0, 3.0), ("hole", 5.0, 5.0), ("out", 20.0, 3.0), ("again", 2.0, 3.0), ("null", None, None)]
    classes = S.point_classes(points(spark, rows), "id", "lat", "lon")
    tree = S.fit_quadtree(classes, 25.0)
    got = {(r.lat, r.lon, r.region) for r in S.holding_regions(classes, regions, tree, "rid", "rings").collect()}
    assert got == {(2.0, 3.0, "a"), (5.0, 5.0, "b")}


def test_empty_and_clashing_columns(spark):
    df = points(spark, [("a", 1.0, 1.0, 1, 2), ("b", 1.0, 1.0, 1, 2)], ", leaf int, class_key int")
    assert [tuple(r) for r in S.near_pairs(df, "id", "lat", "lon", 25.0).collect()] == [("a", "b")]
    assert S.near_pairs(df.limit(0), "id", "lat", "lon", 25.0).count() == 0


def test_quadtree_leaves_cover_the_globe():
    rng = np.random.default_rng(2)
    starts = S.build_quadtree(rng.normal(50, 1, 5000), rng.normal(-8, 1, 5000), 64, (1e-3, 1e-3))
    boxes = S.leaf_boxes(starts)
    assert np.isclose(((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])).sum(), 360 * 180)
    lon, lat = rng.uniform(-180, 180, 1000), rng.uniform(-90, 90, 1000)
    at = boxes[S._leaf_of(starts, lon, lat)]
    assert ((at[:, 0] <= lon) & (lon <= at[:, 2]) & (at[:, 1] <= lat) & (lat <= at[:, 3])).all()


def test_a_polar_point_does_not_widen_the_leaves_of_a_town():
    rng = np.random.default_rng(3)
    lat, lon, reach = rng.uniform(53.0, 53.2, 20_000), rng.uniform(-8.2, -8.0, 20_000), (1e-3, 1e-3)
    largest = []
    for extra in ((), (89.0,)):
        starts = S.build_quadtree(np.append(lat, extra), np.append(lon, [1.0] * len(extra)), 128, reach)
        largest.append(np.bincount(S._leaf_of(starts, lon, lat)).max())
    assert largest[0] == largest[1] < 500
    boxes = S.leaf_boxes(starts)
    far = np.minimum(np.maximum(np.abs(boxes[:, 1]), np.abs(boxes[:, 3])), S.POLAR)
    assert (boxes[:, 2] - boxes[:, 0] >= 1e-3 / np.cos(np.radians(far)) - 1e-12).all()


def test_a_crowded_leaf_is_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_LEAF", 20)
    rng = np.random.default_rng(4)
    rows = [(f"{i:03d}", float(53 + 2e-4 * rng.random()), float(-8 + 2e-4 * rng.random())) for i in range(400)]
    df = points(spark, rows)
    classes = S.point_classes(df, "id", "lat", "lon")
    tree = S.fit_quadtree(classes, 10.0)
    assert tree.parts.max() > 1
    assert {tuple(r) for r in S.near_pairs(df, "id", "lat", "lon", 10.0).collect()} == brute(rows, 10.0)
    links = {r.class_key: (r.n, r.links, r.keys_linked) for r in S.class_links(classes, S.near_classes(classes, tree, 10.0)).collect()}
    pairs = brute(rows, 10.0)
    assert links == {k: (1, n := sum(k in p for p in pairs), n) for k, _, _ in rows}


def test_clipped_regions_hold_what_whole_ones_hold():
    rng = np.random.default_rng(5)
    for _ in range(60):
        rings = []
        for _ in range(rng.integers(1, 4)):
            n = rng.integers(3, 30)
            turn = np.sort(rng.uniform(0, 2 * np.pi, n))
            far = rng.uniform(0.1, 1, n) * rng.uniform(0.2, 3)
            x, y = rng.normal(0, 0.5) + far * np.cos(turn), rng.normal(0, 0.5) + np.round(far * np.sin(turn), rng.integers(1, 9))
            rings.append((np.append(x, x[0]), np.append(y, y[0])))
        xs, ys = (np.concatenate([r[k] for r in rings]) for k in (0, 1))
        sizes = np.array([len(r[0]) for r in rings])
        left, foot = rng.uniform(-2, 1, 2)
        box = np.array([left, foot, left + rng.uniform(0.05, 1.5), foot + rng.uniform(0.05, 1.5)])
        lon, lat = rng.uniform(box[0], box[2], 200), np.round(rng.uniform(box[1], box[3], 200), rng.integers(1, 9)).clip(box[1], box[3])
        odd = np.zeros(200, bool)
        for x, y in rings:
            for x0, y0, x1, y1 in zip(x[:-1], y[:-1], x[1:], y[1:]):
                if y0 != y1:
                    odd ^= ((y0 > lat) != (y1 > lat)) & (lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0)
        assert (S.inside_clip(lat, lon, *S.clip_region(xs, ys, sizes, box)) == odd).all()
