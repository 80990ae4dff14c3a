from datetime import date, timedelta

import numpy as np

from tidemark.operators import rolling

START = date(2021, 12, 20)


def run(spark, rows, periods=(3, 5)):
    df = spark.createDataFrame(rows, "e string, d date, v double, at int, lag int")
    got = rolling.trailing_totals(df, "e", "d", {"m": ("v", 1e-3)}, list(periods))
    return {(r.e, (r.d - START).days): r for r in got.collect()}


def test_agrees_with_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    days = sorted(rng.choice(60, 25, replace=False).tolist())
    value = {k: round(float(rng.normal()), 3) for k in days if k % 5}
    rows = [("a", START + timedelta(days=k), value.get(k), 1, 1) for k in days] * 2
    got = run(spark, rows)
    assert sorted(k for _, k in got) == list(range(days[0], days[-1] + 1))
    for (_, k), r in got.items():
        assert r.has_m == (k in value)
        for p in (3, 5):
            inside = [round(value[j] * 1000) for j in range(k - p + 1, k + 1) if j in value]
            assert (r[f"n_m_{p}"], r[f"total_m_{p}"]) == (len(inside), sum(inside))
            assert r[f"avg_m_{p}"] == (sum(inside) / len(inside) if inside else None)


def test_nulls_infinities_single_rows_and_empty(spark):
    rows = [("a", START, float("nan"), 0, 0), ("b", START, float("inf"), 0, 0), ("c", START, None, 0, 0), (None, START, 1.0, 0, 0), ("d", None, 1.0, 0, 0), ("e", START, 1.5, 0, 0), ("e", START, None, 0, 0)]
    got = run(spark, rows)
    assert {(e, k): (r.has_m, r.total_m_3) for (e, k), r in got.items()} == {("a", 0): (False, 0), ("b", 0): (False, 0), ("c", 0): (False, 0), ("e", 0): (True, 1500)}
    assert run(spark, rows[:0]) == {}


def test_one_shuffle_after_the_repeats_are_gone(spark):
    df = spark.createDataFrame([("a", START, 1.0)], "e string, d date, v double")
    plan = rolling.trailing_totals(df, "e", "d", {"m": ("v", 1.0)}, [7, 30])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
