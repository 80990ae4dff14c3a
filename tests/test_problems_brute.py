"""p2_found, p3_found and p4_found against plain Python over the small tables."""

import re
from collections import defaultdict
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from tidemark.plans import problems

NAMED = {"BST": 1, "IST": 1, "CET": 1, "CEST": 2, "GMT": 0, "UTC": 0, "Z": 0}
PLAIN = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z|\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\+00:00")
ALWAYS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y/%m/%d %H:%M", "%Y%m%dT%H%M%S", "%Y-%jT%H:%M:%S", "%d-%b-%Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%Y-%m-%d %H:%M"]
ORDERED = {"dmy": ["%d.%m.%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%y %H:%M"], "mdy": ["%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M %p"], "ymd": []}


def read(text, order):
    """('u', ms) for an instant, ('l', ms) for a clock time, None for neither."""
    s = text.strip().upper()
    if s.isdigit():
        return "u", int(s) * (1000 if len(s) <= 11 else 1)
    body = r"(.*:\d\d(?:[.,]\d+)?(?: [AP]M)?|.*T\d{6})"
    m = re.fullmatch(body + r" ?(Z|[A-Z]{3,4}|[+-]\d\d(?::?\d\d)?)", s) or re.fullmatch(body + "()", s)
    if not m:
        return None
    b, zone, late, ms = m[1], m[2], False, 0
    if x := re.search(r"[T ]24:00(:00(?:[.,]0+)?)?$", b):
        b, late = b[: x.start()] + x[0].replace("24:", "00:"), True
    if x := re.search(r"[.,](\d+)$", b):
        b, ms = b[: x.start()], int((x[1] + "000")[:3])
    for f in ALWAYS + ORDERED.get(order, []):
        try:
            t = datetime.strptime(b, f) + timedelta(days=late)
            break
        except ValueError:
            pass
    else:
        return None
    clock = int((t - datetime(1970, 1, 1)).total_seconds()) * 1000 + ms
    if not zone:
        return "l", clock
    if zone[0] in "+-":
        d = zone[1:].replace(":", "")
        return "u", clock - (1 if zone[0] == "+" else -1) * (int(d[:2]) * 60 + int(d[2:] or 0)) * 60_000
    return ("u", clock - NAMED[zone] * 3_600_000) if zone in NAMED else None


@pytest.fixture(scope="module")
def instants(sf):
    rows = pd.read_parquet(f"{sf}/gauge_readings.parquet").merge(pd.read_parquet(f"{sf}/gauge_files.parquet")[["file_id", "clock_zone", "date_order"]], on="file_id", how="left")
    out, last, wrapped = {}, {}, set()
    for r in rows.sort_values(["file_id", "line_no"]).itertuples():
        got = read(r.datetime, r.date_order) if isinstance(r.datetime, str) else None
        if got is None:
            continue
        kind, ms = got
        if kind == "l":
            if not isinstance(r.clock_zone, str):
                continue
            if re.fullmatch(r"[+-]\d\d:\d\d", r.clock_zone):
                ms -= (1 if r.clock_zone[0] == "+" else -1) * int(r.clock_zone[1:3]) * 3_600_000
            else:
                t, z = datetime(1970, 1, 1) + timedelta(milliseconds=ms), ZoneInfo(r.clock_zone)
                first, second = (t.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1))
                if first < second:
                    continue
                if first > second:
                    k = (r.file_id, t.date())
                    if ms <= last.get(k, ms - 1):
                        wrapped.add(k)
                    last[k] = ms
                    first = second if k in wrapped else first
                ms -= int(first.total_seconds() * 1000)
        out[r.reading_id] = (r.station_ref, ms, r.value, bool(PLAIN.fullmatch(r.datetime)))
    return out


def test_p2_found(spark, sf, instants):
    got = {r.reading_id: r.utc_ms for r in problems.p2_found(spark, sf).collect()}
    assert got == {k: ms for k, (_, ms, _, plain) in instants.items() if not plain}


def test_p4_found(spark, sf, instants):
    filled = defaultdict(set)
    for station, ms, value, _ in instants.values():
        if 0 <= value <= 125:
            filled[station].add(ms // 900_000)
    want = set()
    for station, slots in filled.items():
        s = sorted(slots)
        want |= {(station, (a + 1) * 900_000, b - a - 1) for a, b in zip(s, s[1:]) if b > a + 1}
    assert {tuple(r) for r in problems.p4_found(spark, sf).collect()} == want


def test_p3_found(spark, sf):
    rows = pd.read_parquet(f"{sf}/antecedent_labels.parquet").drop_duplicates(["station_id", "label_date"]).sort_values(["station_id", "label_date"])
    want = set()
    for station, x in rows.groupby("station_id"):
        day = (pd.to_datetime(x.label_date) - pd.to_datetime(x.label_date.iloc[0])).dt.days.to_numpy()
        name = {k: str(d)[:10] for k, d in zip(day, x.label_date)}
        v = np.full(day[-1] + 1, np.nan)
        v[day] = x.mean_level.to_numpy(float)
        bad = (v < 0) | (v > 125)
        found = []
        for n in (1, 2, 3):
            for s in range(1, len(v) - n):
                run, a, b = v[s : s + n], v[s - 1], v[s + n]
                if np.isnan([*run, a, b]).any() or bad[s - 1] or bad[s + n]:
                    continue
                least = min(np.abs(run - a).min(), np.abs(run - b).min())
                if abs(a - b) < least:
                    found.append((s, n, least))
        while True:
            case = np.zeros(len(v), bool)
            for s, n, _ in found:
                case[s : s + n] = True
            ok = ~(case | bad)
            step = np.abs(np.diff(v))
            step = step[ok[1:] & ok[:-1] & ~np.isnan(step)]
            kept = [f for f in found if f[2] > 2 * (step.max() if len(step) else np.inf)]
            if len(kept) == len(found):
                break
            found = kept
        case |= bad
        at = np.nonzero(~np.isnan(v) & ~bad)[0]
        runs = np.split(at, np.nonzero(np.diff(v[at]))[0] + 1)
        long = [r for r in runs if len(r) >= 10]
        others = [v[a] == v[b] for r, q in zip(runs, [*runs[1:], []]) for a, b in [*(zip(r, r[1:]) if len(r) < 10 else []), *([(r[-1], q[0])] if len(q) else [])]]
        if others and np.mean(others) <= 0.5:
            for r in long:
                case[r] = True
        want |= {(station, name[k], "mean_level") for k in np.nonzero(case)[0]}
        want |= {(station, name[k], "standardized_anomaly") for k, z in zip(day, x.standardized_anomaly) if abs(z) > 8}
        n = x.quality_code.value_counts()
        want |= {(station, name[k], "quality_code") for k, c in zip(day, x.quality_code) if c == c and c is not None and n.get(c, 0) / len(x) < 0.03}
    assert {tuple(r) for r in problems.p3_found(spark, sf).collect()} == want
