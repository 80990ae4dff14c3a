"""Pixels in long form (site, day, row, col, band values): masks, indices, statistics, tiles, focal means, time bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import small_side

CLOUD_CLASSES = [0, 1, 3, 8, 9, 10]


def decibel(x: Column) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(1e-6)))


def difference_index(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def clear_sky(scl: Column) -> Column:
    return F.coalesce(~scl.isin(CLOUD_CLASSES), F.lit(False))


def as_pixels(vectors: DataFrame, site: str, day: Column, vector: str, width: int) -> DataFrame:
    """One pixel a vector element: site, day, row, col, v."""
    cells = vectors.select(F.col(site).alias("site"), day.alias("day"), F.posexplode(vector).alias("pos", "x"))
    return cells.select("site", "day", F.floor(F.col("pos") / width).cast("int").alias("row"), (F.col("pos") % width).alias("col"), F.col("x").cast("double").alias("v"))


def zonal(pixels: DataFrame) -> DataFrame:
    """Per site and day: mean, deviation and median of the values and of their decibels, share of valid pixels."""
    db = decibel(F.col("v"))
    ok = F.col("v").isNotNull()
    return pixels.groupBy("site", "day").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg(F.when(ok, db)).alias("db_mean"), F.stddev_pop(F.when(ok, db)).alias("db_std"),
        F.median(F.when(ok, db)).alias("db_median"), (F.count("v") / F.count("*")).alias("valid_frac"),
    )


def zonal_bands(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Per site and day the valid share and, of each band, mean, deviation and the mean of the decibels; a pixel is valid if all bands are."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(b) > 0, F.lit(False)) for b in bands])
    stats = [
        f(F.when(ok, decibel(F.col(b)) if db else F.col(b))).alias(f"{b}_{name}")
        for b in bands for name, f, db in (("mean", F.avg, False), ("std", F.stddev_pop, False), ("db_mean", F.avg, True))
    ]
    return pixels.groupBy("site", "day").agg((F.count_if(ok) / F.count("*")).alias("valid_frac"), *stats)


def index_means(pixels: DataFrame, a: str, b: str, scl: str) -> DataFrame:
    """Per site and day the mean normalised difference of two bands over clear pixels, and their share."""
    ok = clear_sky(F.col(scl))
    index = difference_index(F.col(a), F.col(b))
    return pixels.groupBy("site", "day").agg(F.avg(F.when(ok, index)).alias("index_mean"), (F.count_if(ok) / F.count("*")).alias("valid_frac"))


def tiles(pixels: DataFrame, size: int, rows: int, cols: int, least: float = 0.5) -> DataFrame:
    """Full tiles without overlap that are valid for at least a share; partial edge tiles drop out."""
    r, c = F.floor(F.col("row") / size), F.floor(F.col("col") / size)
    full = pixels.filter((r < rows // size) & (c < cols // size))
    got = full.groupBy("site", "day", r.alias("tile_row"), c.alias("tile_col")).agg(
        (F.count("v") / F.lit(size * size)).alias("valid"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )
    return got.filter(F.col("valid") >= least)


def focal_mean(pixels: DataFrame, points: DataFrame, reach: int = 1) -> DataFrame:
    """Mean of the window around each point where more than half of it is valid; windows are cut at the edges."""
    k = (2 * reach + 1) ** 2
    around = F.sequence(F.lit(-reach), F.lit(reach))
    near = points.select("*", F.explode(around).alias("dr")).select("*", F.explode(around).alias("dc"))
    near = near.select("site", "day", "row", "col", (F.col("row") + F.col("dr")).alias("r2"), (F.col("col") + F.col("dc")).alias("c2"))
    cells = pixels.select("site", "day", F.col("row").alias("r2"), F.col("col").alias("c2"), "v")
    got = near.join(cells, ["site", "day", "r2", "c2"]).groupBy("site", "day", "row", "col").agg(F.avg("v").alias("m"), F.count("v").alias("n"))
    return got.select("site", "day", "row", "col", F.when(F.col("n") >= (k + 1) // 2, F.col("m")).alias("focal"), "n")


def sample_pixels(pixels: DataFrame, k: int) -> DataFrame:
    """k pixels a site, by a seed from the site's name: the same draw on every run, whatever the partitioning."""
    seed = F.crc32(F.col("site").cast("string")).bitwiseAND(2147483647)
    order = F.xxhash64(seed, "row", "col")
    cells = pixels.select("site", "row", "col").distinct().withColumn("seed", seed)
    rank = F.row_number().over(Window.partitionBy("site").orderBy(order, "row", "col"))
    return cells.withColumn("k", rank).filter(F.col("k") <= k).select("site", "seed", "row", "col")


def temporal_bins(targets: DataFrame, observed: DataFrame, steps: int = 12, step_days: int = 30) -> DataFrame:
    """Mean of each series' observations in causal bins before each target day; the newest bin is the last step.

    A target is written once for each stretch of step_days that its bins reach into, so that site and stretch
    are an equi-key and observations meet only targets within reach.
    """
    age = F.datediff("target_day", "day")
    stretch = lambda day: F.floor(F.unix_date(day) / step_days)
    reached = F.sequence(stretch(F.date_sub("target_day", steps * step_days - 1)), stretch("target_day"))
    wide = targets.select("site", "target_day", F.explode(reached).alias("__stretch"))
    pairs = wide.join(observed.withColumn("__stretch", stretch("day")), ["site", "__stretch"]).filter((age >= 0) & (age < steps * step_days))
    step = F.lit(steps - 1) - F.floor(age / step_days)
    return pairs.groupBy("site", "target_day", "series", step.cast("int").alias("step")).agg(F.avg("v").alias("value"), F.count("v").alias("n"))


def missing_patterns(bins: DataFrame, steps: int = 12) -> DataFrame:
    """Number of series for each pattern of filled steps, as a bit mask, and the month of the first step."""
    mask = F.sum(F.when(F.col("n") > 0, F.pow(F.lit(2.0), F.col("step"))).otherwise(0.0)).cast("bigint")
    per = bins.groupBy("site", "target_day", "series").agg(mask.alias("mask"), F.count("*").alias("filled"))
    month = F.month(F.date_sub("target_day", (steps - 1) * 30 + 15))
    return per.groupBy("mask", month.alias("start_month")).agg(F.count("*").alias("n"), F.max("filled").alias("filled"))


def vector_mean(vectors: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of a key, ignoring nulls and NaN, and how many there were."""
    cells = vectors.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.when(~F.isnan("x"), F.col("x").cast("double")))
    means = cells.groupBy(*keys, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("pooled"), F.max("n").alias("n_patches"))


def standardise(cells: DataFrame, bands: DataFrame) -> DataFrame:
    """(x - mean) / std of the cell's band, looked up by name; null, NaN and infinite results are 0.

    A band without statistics raises, as a silent 0 would hide a misspelt name.
    """
    known = cells.join(small_side(bands), "band", "left")
    z = (F.col("x") - F.col("band_mean")) / F.nullif(F.col("band_std"), F.lit(0.0))
    z = F.when(F.col("band_mean").isNull(), F.raise_error(F.concat(F.lit("no statistics for band "), F.col("band"))).cast("double")).otherwise(z)
    return known.withColumn("z", F.when(~F.isnan(z) & (F.abs(z) < float("inf")), z).otherwise(0.0)).drop("band_mean", "band_std")


def model_input(bins: DataFrame, steps: int = 12) -> DataFrame:
    """Fixed-width rows for a series model: scaled values (value + 25) / 25, 0 where missing, and the mask (1 = missing)."""
    filled = F.map_from_entries(F.collect_list(F.struct("step", "value")))
    rows = bins.filter("n > 0").groupBy("site", "target_day", "series").agg(filled.alias("m"))
    at = F.sequence(F.lit(0), F.lit(steps - 1))
    return rows.select(
        "site", "target_day", "series",
        F.transform(at, lambda k: F.coalesce((F.try_element_at("m", k) + 25) / 25, F.lit(0.0))).alias("x"),
        F.transform(at, lambda k: F.try_element_at("m", k).isNull().cast("int")).alias("mask"),
    )


def gated_pool(bins: DataFrame, observed: DataFrame, min_series: int = 20, min_steps: int = 2) -> DataFrame:
    """Per site and target day the mean over series, null unless enough series were seen on the day itself and enough are kept.

    observed: site, day, series, v. A series is kept if it has min_steps filled steps.
    """
    per = bins.filter("n > 0").groupBy("site", "target_day", "series").agg(F.count("*").alias("steps"), F.avg("value").alias("value"))
    on_day = observed.filter("v is not null").groupBy("site", F.col("day").alias("target_day")).agg(F.count_distinct("series").alias("seen"))
    kept = per.filter(F.col("steps") >= min_steps).groupBy("site", "target_day").agg(
        F.count("*").alias("n_series"), F.avg("steps").alias("mean_steps"), F.avg("value").alias("pooled")
    )
    all_ = per.select("site", "target_day").distinct().join(kept, ["site", "target_day"], "left").join(on_day, ["site", "target_day"], "left")
    ok = (F.coalesce("seen", F.lit(0)) >= min_series) & (F.coalesce("n_series", F.lit(0)) >= min_series)
    return all_.select("site", "target_day", F.coalesce("n_series", F.lit(0)).alias("n_series"), "mean_steps", F.when(ok, F.col("pooled")).alias("pooled"))


def coordinate_groups(cube: DataFrame, digits: int = 6) -> DataFrame:
    """Years of a site whose pixels lie at equal (rounded) coordinates share a group, named by its first year; only those may be joined into one series."""
    spot = F.struct("series", F.round("x", digits), F.round("y", digits))
    print_ = F.xxhash64(F.sort_array(F.collect_set(spot)))
    per = cube.groupBy("site", "year").agg(print_.alias("print"), F.count_distinct("series").alias("pixels"))
    return per.withColumn("group", F.min("year").over(Window.partitionBy("site", "print")))
