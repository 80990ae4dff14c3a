"""Irregular readings onto a regular grid by a Kalman smoother with a continuous-time local trend.

Readings are first averaged inside each grid slot (partial aggregation before the shuffle, so that a
gauge holding a third of all readings shrinks to at most one row per slot). Sorted by source and slot,
the slots run through a forward filter and a backward smoother of an integrated Wiener process, whose rate
against the readings' noise is fitted to each source; holes are then evaluated in closed form between the
smoothed states at their two ends.

A long series is smoothed in windows of ``WINDOW`` slots with ``MARGIN`` slots of context on both sides;
the influence of an observation decays geometrically with the observations between, so the seams agree
with the unbroken smoother to well under a thousandth of the level's noise (tested, and counted over whole
tables by ``seams``). ``window=None`` smooths every series unbroken.

Defined results
---------------
* readings without instant, or whose value is null, NaN, infinite or out of [low, high], fill nothing;
* a slot is missing if no reading falls in it; only slots between the first and last filled one appear;
* repeated readings weigh twice in their slot's mean; null sources are dropped, an empty input gives no row;
* one filled slot gives one row, with its mean as value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, MARGIN = 512, 96
#: Variance that a source's slope gains per slot, in units of a reading's noise variance: without a fit, and the bounds of one.
RATE, LEAST_RATE, MOST_RATE = 0.01, 1e-3, 1.0
#: Slots of the longer of the two steps over which a source's second differences are taken.
LONG = 8
#: Rows a task gathers before it smooths them together.
BATCH_ROWS = 200_000


def fill_slots(instants: DataFrame, source: str, us: str, value: str, slot_s: int, low: float, high: float) -> DataFrame:
    """source, slot, mean value, mean offset of the readings from the slot's start (s) and their number."""
    slot_us = slot_s * 1_000_000
    ok = instants.filter(F.col(source).isNotNull() & F.col(us).isNotNull() & F.col(value).between(low, high))
    return ok.groupBy(F.col(source).alias("source"), F.floor(F.col(us) / slot_us).cast("bigint").alias("slot")).agg(
        F.avg(value).alias("level"), F.avg((F.col(us) - F.floor(F.col(us) / slot_us) * slot_us) / 1e6).alias("offset_s"),
        F.count("*").alias("n"),
    )


def fitted_rates(slot: np.ndarray, v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rate of each source (its rows begin at first) from the variances of second differences over short and long steps.

    Over steps of L slots, with noise r and rate q, these have variance 6r + 2qL³/3. Sources with under 20
    long ones over unbroken slots get RATE.
    """
    ends = np.append(first[1:], len(v))
    rates = np.full(len(first), RATE)

    def variance(a: int, b: int, step: int) -> float | None:
        unbroken = slot[a + 2 * step : b] - slot[a : b - 2 * step] == 2 * step
        if unbroken.sum() < 20:
            return None
        d = (v[a + 2 * step : b] - 2 * v[a + step : b - step] + v[a : b - 2 * step])[unbroken]
        top = 6 * np.median(np.abs(d)) + 1e-12  # a few leaps must not set the rate
        return float((np.clip(d, -top, top) ** 2).mean())

    for k, (a, b) in enumerate(zip(first, ends)):
        far = variance(a, b, LONG) if b - a > 2 * LONG else None
        near = variance(a, b, 1) if far is not None else None
        if near is not None:
            q = max(0.0, 1.5 * (far - near) / (LONG**3 - 1))
            r = (near - 2 * q / 3) / 6
            rates[k] = np.clip(q / r, LEAST_RATE, MOST_RATE) if r > 0 else MOST_RATE
    return rates


def smooth(t: np.ndarray, v: np.ndarray, r: np.ndarray, real: np.ndarray, q: float | np.ndarray) -> tuple[np.ndarray, ...]:
    """Level, slope and level variance (in units of the noise) of an integrated Wiener process at the observations.

    All arguments are matrices, a row per series, padded on the right where real is False. Time is in slots.
    """
    rows, cols = t.shape
    dt = np.diff(t, axis=1, prepend=t[:, :1])
    fx, fv = np.zeros((cols, rows)), np.zeros((cols, rows))
    p00, p01, p11 = (np.zeros((cols, rows)) for _ in range(3))
    x, s = v[:, 0].copy(), np.zeros(rows)
    a, b, c = np.full(rows, 1e4), np.zeros(rows), np.full(rows, 1e2)
    prior = []
    for k in range(cols):
        d = dt[:, k]
        x = x + s * d
        d2 = d * d
        a, b, c = a + 2 * d * b + d2 * c + q * d2 * d / 3, b + d * c + q * d2 / 2, c + q * d
        prior.append((x, s, a, b, c))
        gain = np.where(real[:, k], 1.0 / (a + r[:, k]), 0.0)
        e = (v[:, k] - x) * gain
        x, s = x + a * e, s + b * e
        a, b, c = a - a * a * gain, b - a * b * gain, c - b * b * gain
        fx[k], fv[k], p00[k], p01[k], p11[k] = x, s, a, b, c
    out_x, out_s, out_a = fx.copy(), fv.copy(), p00.copy()
    sa, sb, sc = p00[-1].copy(), p01[-1].copy(), p11[-1].copy()
    for k in range(cols - 2, -1, -1):
        px, ps, pa, pb, pc = prior[k + 1]
        d = dt[:, k + 1]
        det = np.maximum(pa * pc - pb * pb, 1e-12)
        # gain G = P F' (P prior)^-1
        m00, m01 = p00[k] + d * p01[k], p01[k]
        m10, m11 = p01[k] + d * p11[k], p11[k]
        g00, g01 = (m00 * pc - m01 * pb) / det, (m01 * pa - m00 * pb) / det
        g10, g11 = (m10 * pc - m11 * pb) / det, (m11 * pa - m10 * pb) / det
        ex, es = out_x[k + 1] - px, out_s[k + 1] - ps
        da, db, dc = sa - pa, sb - pb, sc - pc
        out_x[k] = fx[k] + g00 * ex + g01 * es
        out_s[k] = fv[k] + g10 * ex + g11 * es
        na = p00[k] + g00 * g00 * da + 2 * g00 * g01 * db + g01 * g01 * dc
        nb = p01[k] + g00 * g10 * da + (g00 * g11 + g01 * g10) * db + g01 * g11 * dc
        nc = p11[k] + g10 * g10 * da + 2 * g10 * g11 * db + g11 * g11 * dc
        same = d == 0  # padding repeats the last state
        sa, sb, sc = np.where(same, sa, na), np.where(same, sb, nb), np.where(same, sc, nc)
        out_x[k], out_s[k] = np.where(same, out_x[k + 1], out_x[k]), np.where(same, out_s[k + 1], out_s[k])
        out_a[k] = sa
    return out_x.T, out_s.T, np.maximum(out_a.T, 0.0)


def smooth_sources(pdf: pd.DataFrame, q: float | None = None, window: int | None = WINDOW) -> pd.DataFrame:
    """Adds level, slope (per slot), sd and rate to sorted slots of whole sources, window by window at once."""
    n = len(pdf)
    window = window or n + 1
    codes = pd.factorize(pdf["source"])[0]
    first = np.searchsorted(codes, np.arange(codes[-1] + 1))
    ends = np.append(first[1:], n)
    slots = pdf["slot"].to_numpy()
    rates = fitted_rates(slots, pdf["level"].to_numpy("float64"), first) if q is None else np.full(len(first), q)
    starts, lo, hi = [], [], []
    for a, b in zip(first, ends):
        s = np.arange(a, b, window)
        starts.append(s)
        lo.append(np.maximum(s - MARGIN, a))
        hi.append(np.minimum(s + window + MARGIN, b))
    rate = np.repeat(rates, list(map(len, starts)))
    starts, lo, hi = map(np.concatenate, (starts, lo, hi))
    stop = np.minimum(starts + window, hi)
    t = pdf["slot"].to_numpy("float64") + pdf["t"].to_numpy()
    v, r = pdf["level"].to_numpy(), 1.0 / pdf["n"].to_numpy("float64")
    x, s, var, scale = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    by = np.argsort(hi - lo, kind="stable")  # windows of like length together
    for part in np.array_split(by, max(1, len(by) // 512)):
        width = int((hi[part] - lo[part]).max())
        at = lo[part][:, None] + np.arange(width)[None, :]
        real = at < hi[part][:, None]
        at = np.minimum(at, hi[part][:, None] - 1)
        tt = t[at] - t[lo[part]][:, None]
        mid = v[lo[part]][:, None]
        wx, ws, wa = smooth(tt, v[at] - mid, r[at], real, rate[part])
        rest = np.where(real, (v[at] - mid - wx) ** 2 / r[at], 0.0).sum(1) / real.sum(1)
        for i, w in enumerate(part):
            k = slice(starts[w] - lo[w], stop[w] - lo[w])
            o = slice(starts[w], stop[w])
            x[o], s[o], var[o], scale[o] = wx[i, k] + mid[i], ws[i, k], wa[i, k], max(rest[i], 1e-8)
    return pdf.assign(x=x, s=s, var=var, scale=scale, q=np.repeat(rates, ends - first))


def _runs(slot_s: int, q: float | None, holes_only: bool, window: int | None):
    def to_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(t=pdf["offset_s"] / slot_s)
        z = smooth_sources(pdf, q, window)
        slot = z["slot"].to_numpy()
        src = z["source"].to_numpy()
        follows = np.append(src[1:] == src[:-1], False)
        gap = np.append(np.diff(slot), 0)
        # a filled slot is evaluated at its start, off the mean instant of its readings
        filled = pd.DataFrame({
            "source": src, "slot": slot, "n_slots": np.int64(1), "missing": False, "value": z["x"] - z["s"] * z["t"],
            "sd": np.sqrt(z["scale"] * z["var"]),
        })
        h = np.nonzero(follows & (gap > 1))[0]
        t = z["t"].to_numpy()
        hole = {"source": src[h], "slot": slot[h] + 1, "n_slots": gap[h] - 1, "missing": True, "value": np.nan, "sd": np.nan}
        ends = {
            "t0": t[h] - 1.0, "t1": gap[h] - 1 + t[h + 1], "x0": z["x"].to_numpy()[h], "x1": z["x"].to_numpy()[h + 1],
            "s0": z["s"].to_numpy()[h], "s1": z["s"].to_numpy()[h + 1],
            "v0": (z["scale"] * z["var"]).to_numpy()[h], "v1": (z["scale"] * z["var"]).to_numpy()[h + 1],
            "w": (z["q"] * z["scale"]).to_numpy()[h],
        }
        holes = pd.DataFrame(hole | ends)
        return holes if holes_only or filled.empty else pd.concat([filled, holes]) if len(holes) else filled.assign(**dict.fromkeys(ends, np.nan))

    def by_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= BATCH_ROWS:
                pdf = pd.concat(held)
                whole = (pdf["source"] != pdf["source"].iloc[-1]).to_numpy()
                if whole.any():
                    yield to_runs(pdf[whole])[COLUMNS]
                held = [pdf[~whole]]
                rows = len(held[0])
        if rows:
            yield to_runs(pd.concat(held))[COLUMNS]

    return by_task


ENDS = ["t0", "t1", "x0", "x1", "s0", "s1", "v0", "v1", "w"]
COLUMNS = ["source", "slot", "n_slots", "missing", "value", "sd", *ENDS]
RUNS = "source string, slot long, n_slots long, missing boolean, value double, sd double, " + ", ".join(f"{c} double" for c in ENDS)


def smoothed_runs(slots: DataFrame, slot_s: int, q: float | None = None, holes_only: bool = False, window: int | None = WINDOW) -> DataFrame:
    """Filled slots and holes of every source, each hole one row with the smoothed states at its ends.

    q: variance that the slope gains per slot, in units of a reading's noise variance; None fits it to each source.
    After fill_slots a source has one row per slot at most, so its rows are bounded by the calendar.
    """
    ordered = slots.repartition("source").sortWithinPartitions("source", "slot")
    return ordered.mapInPandas(_runs(slot_s, q, holes_only, window), RUNS)


def to_grid(runs: DataFrame, slot_s: int) -> DataFrame:
    """One row per source and grid time: value with its standard deviation, holes evaluated and marked.

    Inside a hole the mean is the cubic that meets level and slope at both ends, the mean of an
    integrated Wiener process between two known states; its variance is that bridge's plus the ends'.
    """
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_slots") - 1)).alias("k")
    cells = runs.select("*", k)
    span = F.col("t1") - F.col("t0")
    u = (F.col("k") - F.col("t0")) / span
    a, b = (1 + 2 * u) * (1 - u) * (1 - u), u * u * (3 - 2 * u)
    mean = a * F.col("x0") + b * F.col("x1") + span * u * (1 - u) * ((1 - u) * F.col("s0") - u * F.col("s1"))
    var = F.col("w") * F.pow(span * u * (1 - u), 3) / 3 + a * a * F.col("v0") + b * b * F.col("v1")
    return cells.select(
        "source",
        F.timestamp_seconds((F.col("slot") + F.col("k")) * slot_s).alias("grid_ts"),
        F.when(F.col("missing"), mean).otherwise(F.col("value")).alias("value"),
        F.when(F.col("missing"), F.sqrt(var)).otherwise(F.col("sd")).alias("sd"),
        "missing",
    )


def seams(slots: DataFrame, slot_s: int, tolerance: float = 1e-3) -> DataFrame:
    """Per source the filled slots, and how many of them windows and the unbroken smoother level more than tolerance of an sd apart."""
    keys = ["source", "slot"]
    broken, whole = (smoothed_runs(slots, slot_s, window=w).filter("not missing").select(*keys, "value", "sd") for w in (WINDOW, None))
    both = broken.join(whole.withColumnsRenamed({"value": "v", "sd": "s"}), keys)
    off = F.abs(F.col("value") - F.col("v")) > tolerance * F.greatest(F.col("s"), F.lit(1e-9))
    return both.groupBy("source").agg(F.count("*").alias("filled"), F.count_if(off).alias("off"))
