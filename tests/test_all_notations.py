"""The time-based queries over readings of every notation, against plain Python over the small tables."""

import json
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from test_problems_brute import instants  # noqa: F401

from tidemark.plans import registry
from tidemark.plans.series import ERA_S


@pytest.fixture(scope="module")
def by_station(instants):  # noqa: F811
    assert not all(plain for *_, plain in instants.values())
    out = defaultdict(list)
    for k, (station, ms, value, _) in instants.items():
        out[station].append((ms // 1000, k, value if 0 <= value <= 125 else np.nan))
    return {st: pd.DataFrame(rows, columns=["s", "id", "v"]) for st, rows in out.items()}


def got(spark, sf, name, key=("station_id",)):
    return {tuple(r[k] for k in key): r for r in registry.QUERIES[name](spark, sf).collect()}


def grid(x, step):
    bins = x.assign(b=x.s // step * step).groupby("b").v.agg(["mean", "sum", "count"])
    return bins.reindex(np.arange(bins.index.min(), bins.index.max() + 1, step))


def test_rows_of_each_station(spark, sf, by_station):
    raw = pd.read_parquet(f"{sf}/gauge_readings.parquet")
    total = raw.groupby("station_ref").size()
    timed, summary, avail, window = (got(spark, sf, f"{n}_all") for n in ("typed_readings", "download_summary", "availability", "half_open_window"))
    assert {k[0]: r.timed for k, r in timed.items() if r.timed} == {st: len(x) for st, x in by_station.items()}
    assert {k[0]: (r.n_rows, r.first_s, r.last_s) for k, r in summary.items()} == {st: (len(x), x.s.min(), x.s.max()) for st, x in by_station.items()}
    assert {k[0]: r.n_bad_timestamps for k, r in avail.items()} == {st: n - len(by_station.get(st, ())) for st, n in total.items()}
    assert {k[0]: r.era_rows for k, r in avail.items() if r.era_rows} == {st: n for st, x in by_station.items() if (n := x.s[x.s >= ERA_S].nunique())}
    at = lambda t: int(pd.Timestamp(t).timestamp())
    assert {k[0]: r.n for k, r in window.items()} == {st: n for st, x in by_station.items() if (n := x.s.between(at("2019-01-01"), at("2024-01-01") - 1).sum())}
    first = got(spark, sf, "dedup_keep_first_all", ("station_id", "s"))
    assert {k: r.reading_id for k, r in first.items()} == {(st, s): i for st, x in by_station.items() for s, i in x.groupby("s").id.min().items()}


@pytest.mark.parametrize("name, step, how", [("resample_quarter", 900, "mean"), ("resample_hourly_sum", 3600, "sum"), ("resample_daily", 86400, "mean")])
def test_bins(spark, sf, by_station, name, step, how):
    rows = got(spark, sf, f"{name}_all", ("station_id", "bin_s"))
    want = {}
    for st, x in by_station.items():
        g = grid(x, step)
        empty = 0.0 if how == "sum" else np.nan
        want |= {(st, b): (empty if not n > 0 else v, int(n) if n == n else 0) for b, v, n in zip(g.index, g[how], g["count"])}
    assert rows.keys() == want.keys()
    assert all(r.n == want[k][1] and np.isclose(np.nan if r.value is None else r.value, want[k][0], atol=1e-4, equal_nan=True) for k, r in rows.items())


def test_completeness_and_gaps(spark, sf, by_station):
    done, islands = got(spark, sf, "completeness_report_all"), got(spark, sf, "gap_islands_all", ("station_id", "start_s", "end_s"))
    reports = {(r := json.loads(text))["station_id"]: r for (text,) in registry.QUERIES["gap_reports"](spark, sf).collect()}
    want, total, gaps = {}, {}, set()
    for st, x in by_station.items():
        g = grid(x, 900)
        full = g["count"].to_numpy() > 0
        total[st] = (len(g), full.sum())
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ~full, [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            start, end = g.index[a], min(g.index[b - 1] + 900, g.index[-1])
            if end - start >= 21600:
                gaps.add((st, start, end))
    assert {k[0]: (r.total, r.available) for k, r in done.items()} == total
    assert islands.keys() == gaps
    assert {k: (r["total"], r["available"]) for k, r in reports.items()} == total
    assert {(k, g["start_s"], g["end_s"]) for k, r in reports.items() for g in r["gaps"] or []} == gaps


def test_days(spark, sf, by_station):
    labels = pd.read_parquet(f"{sf}/antecedent_labels.parquet")
    labels["day"] = pd.to_datetime(labels.label_date).dt.strftime("%Y-%m-%d")
    days = {(st, d) for st, x in by_station.items() for d in pd.to_datetime(x.s, unit="s").dt.strftime("%Y-%m-%d")}
    n = labels.groupby(["station_id", "day"]).size().to_dict()
    want = {k: (int(k in days), n.get(k, 0)) for k in days | n.keys() if k not in days or n.get(k, 0) != 1}
    assert {k: (r.n_left, r.n_right) for k, r in got(spark, sf, "reconcile_days_all", ("station_id", "day")).items()} == want
    levels = labels[labels.mean_level.between(0, 125)].groupby(["station_id", "day"]).mean_level.max().to_dict()
    shared = defaultdict(list)
    for st, x in by_station.items():
        for b, v in grid(x, 86400)["mean"].dropna().items():
            if (k := (st, str(pd.Timestamp(b, unit="s"))[:10])) in levels:
                shared[st].append(abs(v - levels[k]))
    rows = got(spark, sf, "recompute_check_all")
    assert {k[0]: r.shared_days for k, r in rows.items()} == {st: len(x) for st, x in shared.items()}
    assert all(np.isclose(r.max_abs_diff, max(shared[k[0]]), atol=1e-4) for k, r in rows.items())
