"""Resampling, coverage and gaps of irregular series. Null values are missing values throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND_US = 1_000_000


def epoch_s(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a time without zone."""
    return F.floor((F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))) / SECOND_US).cast("bigint")


def bin_start(seconds: Column, step_s: int) -> Column:
    return (F.floor(seconds / step_s) * step_s).cast("bigint")


def resample(readings: DataFrame, step_s: int, how: str = "mean") -> DataFrame:
    """Left-closed, left-labelled bins between a station's first and last bin; empty bins are null, or 0 for sums."""
    at = bin_start(epoch_s("ts"), step_s).alias("bin_s")
    value = F.avg("value") if how == "mean" else F.sum("value")
    bins = readings.filter("ts is not null").groupBy("station_id", at).agg(value.alias("value"), F.count("value").alias("n"))
    return on_spine(bins, step_s, 0.0 if how == "sum" else None)


def on_spine(bins: DataFrame, step_s: int, empty: float | None = None) -> DataFrame:
    """Adds the missing bins between each row and the next of its station; no second pass over the bins."""
    following = F.lead("bin_s").over(Window.partitionBy("station_id").orderBy("bin_s"))
    spread = bins.withColumn("next_s", F.coalesce(following, F.col("bin_s") + step_s))
    every = spread.select("*", F.explode(F.sequence(F.col("bin_s"), F.col("next_s") - step_s, F.lit(step_s).cast("bigint"))).alias("at"))
    own = F.col("at") == F.col("bin_s")
    filled = F.when(own, F.col("value")) if empty is None else F.coalesce(F.when(own, F.col("value")), F.lit(empty))
    return every.select("station_id", F.col("at").alias("bin_s"), filled.alias("value"), F.when(own, F.col("n")).otherwise(0).alias("n"))


def completeness(grid: DataFrame, threshold: float = 0.7) -> DataFrame:
    share = F.count("value") / F.count("*")
    return grid.groupBy("station_id").agg(
        F.count("*").alias("total"), F.count("value").alias("available"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.bround(100 * share, 2).alias("completeness_pct"), (share >= threshold).alias("passes"),
    )


def gaps(grid: DataFrame, step_s: int, least_s: int) -> DataFrame:
    """Runs of missing bins of at least least_s: from the first missing bin to the next valid one, or to the last bin at the end."""
    w = Window.partitionBy("station_id").orderBy("bin_s")
    island = F.count("value").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.max("bin_s").over(Window.partitionBy("station_id"))
    runs = grid.withColumns({"island": island, "last_s": last}).filter("value is null").groupBy("station_id", "island").agg(
        F.min("bin_s").alias("start_s"), F.least(F.max("bin_s") + step_s, F.max("last_s")).alias("end_s")
    )
    return runs.filter(F.col("end_s") - F.col("start_s") >= least_s).select("station_id", "start_s", "end_s", ((F.col("end_s") - F.col("start_s")) / 3600).alias("hours"))


def gap_report(grid: DataFrame, step_s: int, least_s: int) -> DataFrame:
    """Coverage with the nested list of gaps, the longest first."""
    found = gaps(grid, step_s, least_s).groupBy("station_id").agg(
        F.count("*").alias("n_gaps"), F.max("hours").alias("longest_gap_h"),
        F.sort_array(F.collect_list(F.struct("hours", "start_s", "end_s")), asc=False).alias("gaps"),
    )
    return completeness(grid).join(found, "station_id", "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))


def top_codes(readings: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent codes of a station as 'code:n; ...', ties by code."""
    n = readings.groupBy("station_id", "quality_code").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("n"), "quality_code"))
    best = n.withColumn("rank", rank).filter(F.col("rank") <= k)
    text = F.transform(F.sort_array(F.collect_list(F.struct("rank", "quality_code", "n"))), lambda x: F.concat_ws(":", x["quality_code"], x["n"]))
    return best.groupBy("station_id").agg(F.array_join(text, "; ").alias("top_codes"))


def dedup_first(readings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order; dropDuplicates would not say which. Repeats go before the shuffle."""
    first = F.min_by(F.struct(*readings.columns), F.struct(*order)).alias("row")
    return readings.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(first).select("row.*")


def with_previous(rows: DataFrame, at: str, out: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the largest ``at`` before the row among the station's rows where the condition holds.

    Windows reach over one station and day; what came before the day is carried over from a summary of one
    row a station and day. So a station that holds a third of all rows is ordered day by day, in many tasks.
    """
    day = F.floor(F.col(at) / 86400)
    parts = rows.withColumn("__day", day)
    within = Window.partitionBy("station_id", "__day").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    over_days = Window.partitionBy("station_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    per_day = parts.groupBy("station_id", "__day").agg(*[F.max(F.when(ok, F.col(at))).alias(f"__{n}") for n, ok in out.items()])
    carried = per_day.select("station_id", "__day", *[F.max(f"__{n}").over(over_days).alias(f"__{n}") for n in out])
    near = parts.withColumns({n: F.max(F.when(ok, F.col(at))).over(within) for n, ok in out.items()})
    both = near.join(carried, ["station_id", "__day"])
    return both.withColumns({n: F.coalesce(n, f"__{n}") for n in out}).drop("__day", *[f"__{n}" for n in out])


def availability(readings: DataFrame, era_s: int, digits: int | None = 2) -> DataFrame:
    """One row per station: record and era coverage, cadence, completeness, flags, longest gap and usability.

    digits: decimals of the shares and durations, rounded half to even; None leaves them as they are.
    """
    rounded = (lambda c: c) if digits is None else (lambda c: F.bround(c, digits))
    timed = readings.withColumn("s", epoch_s("ts"))
    per = timed.groupBy("station_id").agg(F.count("*").alias("total_rows"), F.count_if(F.col("ts").isNull()).alias("n_bad_timestamps"))
    era = dedup_first(timed.filter(F.col("s") >= era_s), ["station_id", "s"], ["reading_id"])
    before = with_previous(era, "s", {"last": F.lit(True), "valid": F.col("value").isNotNull()})
    steps = before.withColumns({"step": F.col("s") - F.col("last"), "hole": F.when(F.col("value").isNotNull(), F.col("s") - F.col("valid"))})
    got = steps.groupBy("station_id").agg(
        F.min("s").alias("era_start_s"), F.max("s").alias("era_end_s"), F.count("*").alias("era_rows"), F.count("value").alias("era_values"),
        F.greatest(F.coalesce(F.median("step"), F.lit(900.0)), F.lit(1.0)).alias("cadence_s"), F.max("hole").alias("longest_s"),
        F.avg(F.col("flag").cast("double")).alias("ok_share"),
    )
    span = F.col("era_end_s") - F.col("era_start_s")
    expected = F.greatest(F.lit(1), F.floor(span / F.col("cadence_s")) + 1)
    out = per.join(got, "station_id", "left").withColumns({
        "span_days": F.floor(span / 86400), "interval_minutes": rounded(F.col("cadence_s") / 60),
        "completeness_pct": rounded(100 * F.col("era_values") / expected), "quality_ok_pct": rounded(100 * F.col("ok_share")),
        "max_gap_days": rounded(F.col("longest_s") / 86400),
        "status": F.when(F.col("total_rows") == F.col("n_bad_timestamps"), "no_valid_timestamps").when(F.col("era_rows").isNull(), "empty").otherwise("ok"),
    })
    usable = (F.col("span_days") >= 5 * 365) & (F.col("completeness_pct") >= 70) & (F.col("max_gap_days").isNull() | (F.col("max_gap_days") <= 60))
    return out.withColumn("usable", F.coalesce(usable, F.lit(False))).drop("cadence_s", "longest_s", "ok_share")


def modal_gap(days: DataFrame) -> DataFrame:
    """Most frequent, median and largest distance of successive days, and the share of the most frequent."""
    step = F.datediff("day", F.lag("day").over(Window.partitionBy("station_id").orderBy("day")))
    n = days.withColumn("step", step).filter("step is not null").groupBy("station_id", "step").agg(F.count("*").alias("n"))
    return n.groupBy("station_id").agg(
        F.max_by("step", F.struct("n", -F.col("step"))).alias("mode_days"), (F.max("n") / F.sum("n")).alias("mode_share"), F.max("step").alias("max_days"),
        F.percentile("step", 0.5, F.col("n")).alias("median_days"),
    )
