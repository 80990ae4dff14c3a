"""Daily antecedent-state labels from daily levels, and their quality checks.

All windows share one partitioning by station; a station has one row per calendar day at most. Input and
output rows are (station_id, day, value); a null value is a missing day and stays a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALPHA = 0.925
#: Days of equal levels in a row from which a station is to be looked at.
STUCK_DAYS = 14


def every_day(days: DataFrame) -> DataFrame:
    """Adds the absent calendar days between a station's rows with a null value."""
    following = F.lead("day").over(Window.partitionBy("station_id").orderBy("day"))
    spread = days.withColumn("next", F.coalesce(following, F.date_add("day", 1)))
    every = spread.select("station_id", "day", "value", F.explode(F.sequence("day", F.date_sub("next", 1))).alias("at"))
    return every.select("station_id", F.col("at").alias("day"), F.when(F.col("at") == F.col("day"), F.col("value")).alias("value"))


def percentile_rank(days: DataFrame, value: str = "value", out: str = "level_percentile") -> DataFrame:
    """Average-tie rank over the record times 100; nulls have none and do not count."""
    all_, tie = Window.partitionBy("station_id"), Window.partitionBy("station_id", value)
    rank = F.rank().over(all_.orderBy(F.col(value).asc_nulls_last()))
    share = 100 * (rank + (F.count("*").over(tie) - 1) / 2) / F.count(value).over(all_)
    return days.withColumn(out, F.when(F.col(value).isNotNull(), share))


def seasonal_anomaly(days: DataFrame, reach: int = 7, least: int = 5) -> DataFrame:
    """Deviation from the pooled days within reach days of the year, in population deviations; null below least values or at 0."""
    mean = F.avg("value").over(Window.partitionBy("station_id"))
    centred = days.withColumns({"doy": F.dayofyear("day"), "c": F.col("value") - mean})
    per_doy = centred.filter("c is not null").groupBy("station_id", "doy").agg(
        F.count("*").alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"), F.min("c").alias("lo"), F.max("c").alias("hi")
    )
    spread = per_doy.select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("off")).select(
        "station_id", (F.pmod(F.col("doy") + F.col("off") - 1, F.lit(366)) + 1).alias("doy"), "n", "s", "ss", "lo", "hi"
    )
    pooled = spread.groupBy("station_id", "doy").agg(*[F.sum(x).alias(f"p_{x}") for x in ("n", "s", "ss")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    m = F.col("p_s") / F.col("p_n")
    sd = F.sqrt(F.greatest(F.col("p_ss") / F.col("p_n") - m * m, F.lit(0.0)))
    ok = (F.col("p_n") >= least) & (F.col("hi") > F.col("lo")) & F.col("c").isNotNull()
    return centred.join(pooled, ["station_id", "doy"], "left").select("station_id", "day", F.when(ok, F.try_divide(F.col("c") - m, sd)).alias("standardized_anomaly"))


def interpolate(days: DataFrame, limit: int = 3) -> DataFrame:
    """Linear interpolation of the first ``limit`` days of each hole; a trailing hole repeats the last value, a leading one stays."""
    w = Window.partitionBy("station_id").orderBy("day")
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("i"))
    rows = days.withColumn("i", F.row_number().over(w)).withColumns({
        "pv": F.last("value", ignorenulls=True).over(past), "pi": F.last(at, ignorenulls=True).over(past),
        "nv": F.first("value", ignorenulls=True).over(future), "ni": F.first(at, ignorenulls=True).over(future),
    })
    blend = F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("i") - F.col("pi")) / (F.col("ni") - F.col("pi"))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(
        F.col("i") - F.col("pi") <= limit, F.when(F.col("nv").isNull(), F.col("pv")).otherwise(blend)
    )
    return rows.select("station_id", "day", "value", filled.alias("filled"))


def baseflow_index(days: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Share of base flow by a recursive filter run both ways over the interpolated days with values.

    The filter q_i = max(0, a q_(i-1) + (1+a)/2 dx_i) equals a running sum less its running minimum after
    scaling by a^-i. The scale would overflow on long records, so the kernel takes it relative to blocks of
    days and hands the filter's state from block to block. A station has at most one row a calendar day.
    Ten days with values or fewer give no index.
    """
    filled = interpolate(days)
    schema = "station_id string, day date, baseflow_index double"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("day")
        has = x["filled"].notna().to_numpy()
        v = x["filled"].to_numpy("float64")[has]
        out = np.full(len(pdf), np.nan)
        at = np.nonzero(has)[0]
        if len(v) > 10:
            base = (_base(v, alpha) + _base(v[::-1], alpha)[::-1]) / 2
            ok = v > 0
            out[at[ok]] = np.clip(base[ok] / v[ok], 0, 1)
        return pd.DataFrame({"station_id": x["station_id"], "day": x["day"], "baseflow_index": out})

    got = filled.groupBy("station_id").applyInPandas(kernel, schema)
    return got.withColumn("baseflow_index", F.when(~F.isnan("baseflow_index"), F.col("baseflow_index")))


def _base(v: np.ndarray, alpha: float) -> np.ndarray:
    """Base part of a series, by the running-minimum form over blocks, the last state of a block opening the next."""
    block, q, out = 512, 0.0, np.empty(len(v))
    d = np.append(0.0, (1 + alpha) / 2 * np.diff(v))
    for a in range(0, len(v), block):
        part = d[a : a + block]
        k = np.arange(1, len(part) + 1)
        s = q + np.cumsum(part * alpha**-k.astype("float64")) if a else np.cumsum(part * alpha**-k.astype("float64"))
        low = np.minimum(np.minimum.accumulate(s), 0.0)
        state = alpha**k * (s - low)
        out[a : a + block] = state
        q = state[-1]
    return np.clip(v - out, 0, np.maximum(v, 0))


def recession_slope(days: DataFrame, width: int = 7, least: int = 4) -> DataFrame:
    """Least-squares slope per day over the trailing rows with values."""
    w = Window.partitionBy("station_id").orderBy("day").rowsBetween(-(width - 1), 0)
    x = F.unix_date("day").cast("double")
    slope = F.regr_slope(F.col("value"), x)
    return days.withColumn("recession_rate", F.when(F.count("value").over(w) >= least, slope.over(w)))


def prominent_peaks(days: DataFrame, share: float = 0.03) -> DataFrame:
    """Days of peaks whose prominence reaches a share of the station's range; plateaus count at their middle."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[pdf["value"].notna()].sort_values("day")
        v = x["value"].to_numpy("float64")
        found = _peaks(v, max(share * (v.max() - v.min()), 1e-6)) if len(v) > 5 else np.array([], int)
        return x.iloc[found][["station_id", "day", "value"]]

    return days.groupBy("station_id").applyInPandas(kernel, "station_id string, day date, value double")


def _peaks(v: np.ndarray, prominence: float) -> np.ndarray:
    """Peaks by one pass with a stack: each keeps the lowest level since the nearest strictly higher sample on either side."""
    start = np.nonzero(np.append(True, v[1:] != v[:-1]))[0]
    stop = np.append(start[1:], len(v)) - 1
    h, n = v[start], len(start)
    lows = []
    for order in (range(n), range(n - 1, -1, -1)):
        low, stack = np.empty(n), []  # stack: (height, lowest level between it and the next higher one before)
        for i in order:
            least = h[i]
            while stack and stack[-1][0] <= h[i]:
                least = min(least, stack.pop()[1])
            low[i] = least
            stack.append((h[i], least))
        lows.append(low)
    inner = np.zeros(n, bool)
    inner[1:-1] = (h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])
    tall = inner & (h - np.maximum(*lows) >= prominence)
    return (start[tall] + stop[tall]) // 2


def days_since_peak(days: DataFrame, peaks: DataFrame) -> DataFrame:
    """Rows since the last peak, null before the first."""
    w = Window.partitionBy("station_id").orderBy("day")
    rows = days.join(peaks.select("station_id", "day", F.lit(True).alias("peak")), ["station_id", "day"], "left").withColumn("i", F.row_number().over(w))
    last = F.last(F.when(F.col("peak"), F.col("i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("station_id", "day", (F.col("i") - last).cast("int").alias("days_since_last_peak"))


def stuck_run(days: DataFrame) -> DataFrame:
    """Longest run of days whose levels agree to 1e-6 plus 1e-5 of the level; missing days are skipped."""
    w = Window.partitionBy("station_id").orderBy("day")
    prior = F.lag("value").over(w)
    rows = days.filter("value is not null").withColumn("new", F.when(F.abs(F.col("value") - prior) <= 1e-6 + 1e-5 * F.abs(prior), 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("new").over(w)).groupBy("station_id", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("station_id").agg(F.when(F.sum("n") < 2, 0).otherwise(F.max("n")).alias("longest_stuck_run_days"))


def label_quality(labels: DataFrame) -> DataFrame:
    """Counts, ranges, out-of-range values, missing shares and the extreme of a label table per station, null days per peak without one."""
    def clean(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c))

    z, b = clean("standardized_anomaly"), clean("baseflow_index")
    p = clean("level_percentile")
    n = F.count("*")
    rows = labels.filter("station_id is not null").withColumns({"z": z, "b": b, "p": p, "r": clean("recession_rate_7d"), "level": clean("mean_level")})
    return rows.groupBy("station_id").agg(
        n.alias("n_rows"), F.count_distinct("label_date").alias("n_days"), F.min("label_date").alias("date_min"), F.max("label_date").alias("date_max"),
        (F.datediff(F.max("label_date"), F.min("label_date")) + 1 - F.count_distinct("label_date")).cast("bigint").alias("n_missing_days"),
        F.min("level").alias("level_min"), F.max("level").alias("level_max"),
        F.count_if((F.col("p") < 0) | (F.col("p") > 100)).alias("percentile_out"), F.count_if((F.col("b") < -1e-6) | (F.col("b") > 1 + 1e-6)).alias("baseflow_out"),
        F.bround(100 * F.count_if(F.col("b").isNull()) / n, 2).alias("baseflow_nan_pct"), F.count_if(F.abs("z") > 8).alias("anomaly_extremes"),
        F.count_if(F.col("days_since_last_peak") == 0).alias("n_peaks"),
        (100 * F.count_if(F.col("z").isNull()) / n).alias("anomaly_nan_pct"), (100 * F.count_if(F.col("r").isNull()) / n).alias("recession_nan_pct"),
        F.try_divide(n, F.count_if(F.col("days_since_last_peak") == 0)).alias("days_per_peak"),
        F.max_by("z", F.when(F.col("z").isNotNull(), F.struct(F.abs("z"), -F.unix_date("label_date")))).alias("extreme_signed"),
        F.max_by("label_date", F.when(F.col("z").isNotNull(), F.struct(F.abs("z"), -F.unix_date("label_date")))).alias("extreme_date"),
        F.max(F.abs("z")).alias("anomaly_max_abs"),
    )


def label_range(days: DataFrame) -> DataFrame:
    """Fewest days with a level in any year from the first to the last of the table, and the 5 to 95 % range."""
    per = days.filter("value is not null").groupBy("station_id", F.year("day").alias("y")).agg(F.count("*").alias("n"))
    years = per.groupBy("station_id").agg(F.min("n").alias("least"), F.count("*").alias("seen"), F.min("y").alias("a"), F.max("y").alias("b"))
    spread = days.filter("value is not null").groupBy("station_id").agg(
        F.when(F.count("*") > 20, F.percentile("value", 0.95) - F.percentile("value", 0.05)).alias("label_range")
    )
    worst = F.when(F.col("seen") < F.col("b") - F.col("a") + 1, 0).otherwise(F.col("least"))
    return years.select("station_id", worst.alias("label_days_min_year")).join(spread, "station_id")


def needs_review(quality: DataFrame, stuck: DataFrame, least_stuck: int = STUCK_DAYS) -> DataFrame:
    """Stations with percentiles or base-flow indices out of range, a long run of equal levels, or an extreme anomaly."""
    rows = quality.join(stuck, "station_id", "left").withColumn("longest_stuck_run_days", F.coalesce("longest_stuck_run_days", F.lit(0)))
    bad = (F.col("percentile_out") > 0) | (F.col("baseflow_out") > 0) | (F.col("longest_stuck_run_days") >= least_stuck) | (F.col("anomaly_extremes") > 0)
    return rows.filter(bad).select("station_id", "percentile_out", "baseflow_out", "longest_stuck_run_days", "anomaly_extremes")
