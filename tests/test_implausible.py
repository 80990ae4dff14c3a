from datetime import date, timedelta

import numpy as np

from tidemark.operators import implausible as I

START = date(2020, 1, 1)


def run(spark, series, anomaly=None, code=None, extra=()):
    rows = [(st, START + timedelta(days=k), v, (anomaly or {}).get((st, k)), (code or {}).get((st, k), 254), "x") for st, vs in series.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame([*rows, *extra], "st string, d date, level double, z double, code int, source string")
    got = I.flag_implausible(df, "st", "d", "level", "z", "code", 0.0, 125.0).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r.st, (r.d - START).days, r.field_name) for r in got}


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.round(5 + np.cumsum(rng.uniform(0.002, 0.02, n) * rng.choice([-1, 1], n)), 3)


def test_spikes_of_one_to_three_days(spark):
    v = walk(200)
    v[50] += 1.0
    v[100:102] -= 0.8
    v[150:153] += 0.6
    assert {k for _, k, f in run(spark, {"a": v.tolist()}) if f == "level"} == {50, 100, 101, 150, 151, 152}


def test_a_flood_is_none_and_makes_small_spikes_ordinary(spark):
    v = walk(200, 1)
    v[80:140] += 2.0 * 0.9 ** np.arange(60)
    v[30] += 1.0  # less than twice the flood's rise
    assert run(spark, {"a": v.tolist()}) == set()
    v[180] += 5.0
    assert run(spark, {"a": v.tolist()}) == {("a", 180, "level")}


def test_impossible_levels_and_gaps(spark):
    v = walk(60, 2).tolist()
    v[10], v[20], v[30], v[40], v[41] = -0.5, 130.0, float("inf"), None, float("nan")
    assert {k for _, k, _ in run(spark, {"a": v})} == {10, 20, 30}


def test_stuck_runs_only_where_levels_move(spark):
    v, still = walk(100, 3), np.repeat(walk(10, 4), 20)
    v[40:52] = v[40]
    v[45] = np.nan
    assert {k for st, k, _ in run(spark, {"a": v.tolist(), "still": still.tolist()}) if st == "a"} == {40, 41, 42, 43, 44, 46, 47, 48, 49, 50, 51}
    assert run(spark, {"still": still.tolist()}) == set()
    v[47:52] = walk(5, 9)
    assert run(spark, {"a": v[:47].tolist()}) == set()  # six equal levels are no run


def test_anomalies_and_rare_codes(spark):
    v = walk(100, 5).tolist()
    z = {("a", 3): 8.0, ("a", 4): -8.1, ("a", 5): float("inf"), ("a", 6): float("nan")}
    assert run(spark, {"a": v}, z, {("a", 7): 31, ("a", 8): 31, ("a", 9): 42, ("a", 10): 42, ("a", 11): 42}) == {("a", 4, "z"), ("a", 5, "z"), ("a", 7, "code"), ("a", 8, "code")}


def test_repeats_nulls_and_empty(spark):
    v = walk(50, 6).tolist()
    v[20] += 2
    extra = [("a", START + timedelta(days=20), v[20], None, 254, "y"), (None, START, -1.0, 9.0, 1, "y"), ("b", None, -1.0, 9.0, 1, "y"), ("c", START, None, None, None, "y")]
    assert run(spark, {"a": v}, extra=extra) == {("a", 20, "level")}
    assert run(spark, {}) == set()
