"""Implausible measurements per source: impossible values, spikes, stuck runs, rare codes.

Each source's days, in order, run through a local-level Kalman filter scaled to that source's own usual
daily change. The update of a standardised innovation above ``THRESHOLD`` is withheld (for
``SPIKE_DAYS`` at most, then the filter accepts the new level). Its innovations propose, and the exact rules
of excursions and stuck runs look at what is proposed only: days about a large innovation, and days whose
innovation has vanished. Neither loses a case. The innovation has always vanished by the ``STUCK_DAYS``-th
equal level; and the limit of a large one falls, source by source, until an ordinary change of the source
shows that an excursion entered below the limit would be too small for the rule.

Rules: a level below ``low``, above ``high`` or infinite; an excursion of one to three days whose every
day is further from the days directly before and after than twice the largest daily change the source
shows outside of excursions, and which returns; ten or more equal levels in a row where fewer than half
of the other days repeat; an anomaly beyond 8; a code on under 3 % of the source's days.

Defined results
---------------
* repeated rows of a source and day count once (the largest non-null value per field);
* null and NaN levels are no cases and do not break a stuck run; rows without source or day are dropped;
* a source with fewer than three levels has no spikes; an empty table gives no rows;
* one row per source, day and field, whatever number of rules it breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 4.0
SPIKE_DAYS = 3
SLACK = 1.1
STUCK_DAYS = 10
STUCK_SHARE = 0.5
ANOMALY = 8.0
RARE = 0.03
BATCH_ROWS = 100_000


def innovations(y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Innovation size of a matrix of series (rows) by day (columns, NaN where absent).

    Local level: the level walks with the series' usual daily change as deviation, readings add a tenth of it.
    """
    n, days = y.shape
    q, r = scale**2, (0.1 * scale) ** 2
    x, p, held = np.full(n, np.nan), np.full(n, 1.0), np.zeros(n, int)
    size = np.full((n, days), np.nan)
    for k in range(days):
        v = y[:, k]
        seen = ~np.isnan(v)
        p = p + q
        e = v - x
        size[:, k] = np.abs(e)
        odd = seen & (np.abs(e) > THRESHOLD * np.sqrt(p + r))
        start = seen & (np.isnan(x) | (odd & (held >= SPIKE_DAYS)))
        gain = np.where(seen & ~odd, p / (p + r), 0.0)
        x = np.where(start, v, np.where(gain > 0, x + gain * np.nan_to_num(e), x))
        p = np.where(start, r, p * (1 - gain))
        held = np.where(start | (seen & ~odd), 0, held + odd)
    return size


def excursions(v: np.ndarray, impossible: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First day, days and least distance of the excursions of v, of any size, that cover or touch the days ``about``.

    These are all that hold one of these days or the day before it, and all that are entered on one or on the day after.
    """
    starts = np.unique(about[:, None] + np.arange(-SPIKE_DAYS, 2))
    parts = [np.empty((3, 0))]
    for length in range(1, SPIKE_DAYS + 1):
        s = starts[(starts >= 1) & (starts < len(v) - length)]
        ok = ~np.isnan(v[s - 1]) & ~np.isnan(v[s + length]) & ~impossible[s - 1] & ~impossible[s + length]
        least = np.full(len(s), np.inf)
        for j in range(length):
            ok &= ~np.isnan(v[s + j])
            least = np.minimum(least, np.minimum(np.abs(v[s + j] - v[s - 1]), np.abs(v[s + j] - v[s + length])))
        ok &= (least > 0) & (np.abs(v[s + length] - v[s - 1]) < np.maximum(least, 1e-12))
        parts.append(np.stack([s[ok], np.full(ok.sum(), length), least[ok]]))
    first, days, least = np.concatenate(parts, axis=1)
    return first.astype(int), days.astype(int), least


def _covered(n: int, first: np.ndarray, days: np.ndarray) -> np.ndarray:
    case = np.zeros(n, bool)
    for j in range(SPIKE_DAYS):
        case[first[days > j] + j] = True
    return case


def proposed(v: np.ndarray, impossible: np.ndarray, size: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The excursions about days of a large innovation, or impossible ones, among which are all that the rule can keep.

    Where neither the day before an excursion nor its first day has an innovation above the limit, the filter has taken over
    the level before but for a hundredth, so that the excursion is entered by little more than the limit. The rule drops it if
    a change in no excursion is over half of that, as one about the proposed days mostly is; else the limit falls.
    Below a limit of 0 the level has not changed at all.
    """
    step = np.abs(np.diff(v))
    for limit in (THRESHOLD * scale, scale, 0.0):
        large = np.flatnonzero(size > limit)
        first, days, least = excursions(v, impossible, np.append(large, np.flatnonzero(impossible)))
        plain = ~(_covered(len(v), first, days) | impossible)
        k = large[large > 0]
        ordinary = step[k - 1][plain[k] & plain[k - 1]]
        if (2 * ordinary > SLACK * limit).any():
            break
    return first, days, least


def spikes(v: np.ndarray, impossible: np.ndarray, size: np.ndarray, scale: float) -> np.ndarray:
    """Days of excursions of one calendar series v (NaN where absent), given the size of its innovations.

    The filter says where to look; the rule decides, by the largest change: the filter's scale is the usual one.
    """
    n = len(v)
    step = np.abs(np.diff(v))
    first, days, least = proposed(v, impossible, size, scale)
    case = np.zeros(n, bool)
    while len(first):
        case = _covered(n, first, days)
        plain = ~(case | impossible)
        usual = step[plain[1:] & plain[:-1] & ~np.isnan(step)]
        kept = least > 2 * (usual.max() if len(usual) else np.inf)
        if kept.all():
            break
        first, days, least = first[kept], days[kept], least[kept]
        case[:] = False
    return case


def stuck(v: np.ndarray, still: np.ndarray) -> np.ndarray:
    """Days of runs of equal levels. v: the levels in a row, still: whether the innovation has vanished there."""
    long = np.zeros(len(v), bool)
    # the step into a run is withheld for SPIKE_DAYS at most, and its rest shrinks a hundredfold a day: gone by the tenth
    at = np.flatnonzero(still)
    at = at[at >= STUCK_DAYS - 1]
    back = np.arange(STUCK_DAYS)
    long[at[(v[at[:, None] - back] == v[at][:, None]).all(axis=1)][:, None] - back] = True
    other = ~(long[1:] & long[:-1])
    if not other.any() or (v[1:] == v[:-1])[other].mean() > STUCK_SHARE:
        return np.zeros(len(v), bool)
    return long


def _level_cases(pdf: pd.DataFrame, low: float, high: float) -> pd.DataFrame:
    """Cases of whole, sorted sources."""
    pdf = pdf.reset_index(drop=True)
    codes = pd.factorize(pdf["source"])[0]
    day, value = pdf["day"].to_numpy(), pdf["level"].to_numpy("float64")
    starts = np.searchsorted(codes, np.arange(codes[-1] + 2))
    impossible = (value < low) | (value > high)
    case = impossible.copy()
    spans = [(a, b, day[b - 1] - day[a] + 1) for a, b in zip(starts[:-1], starts[1:])]
    by_length = sorted(range(len(spans)), key=lambda i: spans[i][2])
    for part in np.array_split(np.array(by_length), max(1, len(by_length) // 64)):
        width = max(spans[i][2] for i in part)
        y = np.full((len(part), width), np.nan)
        scale = np.empty(len(part))
        for j, i in enumerate(part):
            a, b, _ = spans[i]
            y[j, day[a:b] - day[a]] = np.where(impossible[a:b] | ~np.isfinite(value[a:b]), np.nan, value[a:b])
            steps = np.abs(np.diff(y[j]))
            steps = steps[~np.isnan(steps)]
            scale[j] = max(1.4826 * np.median(steps) if len(steps) else 0.0, 5e-4)
        size = innovations(y, scale)
        for j, i in enumerate(part):
            a, b, span = spans[i]
            at = day[a:b] - day[a]
            full = np.full(span, np.nan)
            full[at] = np.where(np.isinf(value[a:b]), np.nan, value[a:b])
            bad = np.zeros(span, bool)
            bad[at] = impossible[a:b]
            case[a:b] |= spikes(full, bad, size[j, :span], scale[j])[at]
            has = ~np.isnan(value[a:b]) & ~impossible[a:b]
            inno = np.nan_to_num(size[j, at[has]], nan=np.inf)
            case[a:b][has] |= stuck(value[a:b][has], inno <= 1e-3 * scale[j] + 1e-9)
    return pdf.loc[case, ["source", "day"]]


def _by_whole_source(fn):
    """Runs fn over batches of whole sources of a task's sorted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= BATCH_ROWS:
                pdf = pd.concat(held)
                whole = (pdf["source"] != pdf["source"].iloc[-1]).to_numpy()
                if whole.any():
                    yield fn(pdf[whole])
                held = [pdf[~whole]]
        if held and sum(map(len, held)):
            yield fn(pd.concat(held))

    return run


def flag_implausible(rows: DataFrame, source: str, day: str, level: str, anomaly: str, code: str, low: float, high: float) -> DataFrame:
    """source, day and field_name of every implausible measurement.

    One shuffle by source and day removes repeats, one by source orders the days; after the first a source
    has one row per day, so that no source can hold more rows than the calendar has days.
    """
    number = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    days = rows.filter(F.col(source).isNotNull() & F.col(day).isNotNull()).groupBy(
        F.col(source).alias("source"), F.unix_date(day).alias("day")
    ).agg(number(level).alias("level"), number(anomaly).alias("anomaly"), F.max(code).alias("code"))
    per_source = days.repartition("source")

    def cases(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [_level_cases(pdf, low, high).assign(field_name=level)]
        out.append(pdf.loc[pdf["anomaly"].abs() > ANOMALY, ["source", "day"]].assign(field_name=anomaly))
        n = pdf.groupby("source")["day"].transform("size")
        held = pdf["code"].notna()
        k = pdf[held].groupby(["source", "code"])["day"].transform("size")
        rare = k / n[held] < RARE
        out.append(pdf.loc[rare.index[rare], ["source", "day"]].assign(field_name=code))
        return pd.concat(out)

    kernel = _by_whole_source(lambda pdf: cases(pdf.reset_index(drop=True)))
    found = per_source.sortWithinPartitions("source", "day").mapInPandas(
        kernel, f"source {dict(rows.dtypes)[source]}, day int, field_name string"
    )
    return found.select(F.col("source").alias(source), F.date_from_unix_date("day").alias(day), "field_name")
