"""Excursions and stuck runs that a threshold on the filter's innovations would miss, and all cases of a larger table."""

import numpy as np
import test_problems_brute
from test_implausible import run, walk


def test_spike_after_a_flagged_day_of_a_gauge_that_hardly_moves(spark):
    v = 3.0 + 0.01 * (np.arange(120) // 8 % 2)
    v[50:53] -= 0.3
    v[80] += 0.2
    assert run(spark, {"a": v.tolist()}) == {("a", k, "level") for k in (50, 51, 52, 80)}


def test_spike_below_the_filter_threshold(spark):
    v = 50 + np.cumsum(np.random.default_rng(0).choice([-1.0, 1.0], 200))
    v[90] += 4.5
    assert run(spark, {"a": v.tolist()}) == {("a", 90, "level")}


def test_short_stuck_runs_whatever_the_step_into_them(spark):
    series, want = {}, set()
    for days in (9, 10, 11, 12):
        for step in (0.02, 0.06, 0.5):
            v = walk(100, days)
            v[40 : 40 + days] = v[39] + step
            v[40 + days :] += v[39] + step - v[40 + days] + 0.011
            series[f"{days} {step}"] = v.tolist()
            want |= {(f"{days} {step}", k, "level") for k in range(40, 40 + days) if days >= 10}
    assert run(spark, series) == want


def test_all_cases_of_a_larger_table(spark):
    test_problems_brute.test_p3_found(spark, "/root/testdata/sf0.1")
