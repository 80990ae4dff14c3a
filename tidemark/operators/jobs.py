"""Work units, manifests and run logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def is_failure(status: Column) -> Column:
    return status.rlike("(?i)error|fail|cancel")


def latest_state(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key of an append-only manifest, by partial aggregation: a hot key shrinks before the shuffle."""
    newest = F.max_by(F.struct(*events.columns), F.struct(*order)).alias("row")
    return events.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(newest).select("row.*")


def open_work(units: DataFrame, states: DataFrame, key: list[str]) -> DataFrame:
    """Units without a state that did not fail."""
    return units.join(states.filter(~is_failure(F.col("status"))), key, "left_anti")


def classify_units(units: DataFrame, done: DataFrame, begun: DataFrame, key: list[str]) -> DataFrame:
    """SKIP what is done, RESUME what has begun, NEW for the rest."""
    d = done.select(*key, F.lit(True).alias("__d")).distinct()
    b = begun.select(*key, F.lit(True).alias("__b")).distinct()
    rows = units.join(d, key, "left").join(b, key, "left")
    return rows.withColumn("state", F.when(F.col("__d"), "SKIP").when(F.col("__b"), "RESUME").otherwise("NEW")).drop("__d", "__b")


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def failure_streaks(log: DataFrame, group: str, order: list[str], failed: Column) -> DataFrame:
    """Longest run of failures in a row per group; a breaker stops at the first of a given length."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = log.withColumn("bad", F.coalesce(failed, F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w))
    runs = rows.filter("bad").groupBy(group, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(group).agg(F.max("n").alias("longest_streak"), F.count("*").alias("streaks"))


def systematic_sample(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """Every floor(n/k)-th row of a group in order, k at most."""
    w = Window.partitionBy(group)
    rn, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    step = F.greatest(F.lit(1), F.floor(n / k))
    picked = rows.withColumns({"__rn": rn, "__step": step}).filter((F.col("__rn") - 1) % F.col("__step") == 0)
    return picked.withColumn("nth", ((F.col("__rn") - 1) / F.col("__step")).cast("int") + 1).filter(F.col("nth") <= k).drop("__rn", "__step")


def safe_to_delete(units: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """SAFE or BLOCKED with the reasons of each unit, a null check blocks."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return units.withColumn("reasons", F.array_join(bad, ",")).withColumn("decision", F.when(F.col("reasons") == "", "SAFE").otherwise("BLOCKED"))


def raw_ready(manifest: DataFrame, key: list[str]) -> DataFrame:
    """Whether every job of a unit was downloaded."""
    return manifest.groupBy(*key).agg(F.bool_and(F.coalesce(F.col("status") == "DOWNLOADED", F.lit(False))).alias("ready"), F.count("*").alias("jobs"))


def ready_units(units: DataFrame, manifest: DataFrame, images: DataFrame, key: list[str], least: int = 5) -> DataFrame:
    """Whether a unit's raw data are there: by its manifest if it has one, else if any sensor brought enough images.

    images: key and sensor, a row an image.
    """
    listed = raw_ready(manifest, key).select(*key, F.col("ready").alias("__listed"))
    found = images.groupBy(*key, "sensor").agg(F.count("*").alias("__n")).groupBy(*key).agg(F.max("__n").alias("__most"))
    rows = units.join(listed, key, "left").join(found, key, "left")
    return rows.withColumn("ready", F.coalesce("__listed", F.col("__most") >= least, F.lit(False))).drop("__listed", "__most")


def submissions(units: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first units of a run, cap at most; the rest waits for the next run."""
    return units.orderBy(*order).limit(cap)


def breaker_stops(log: DataFrame, group: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """The row of each group at which a breaker stops: the first that ends ``most`` failures in a row."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = log.withColumn("__bad", F.coalesce(failed, F.lit(False)).cast("int")).withColumn("__run", F.sum("__bad").over(w.rowsBetween(1 - most, 0)))
    stops = rows.filter(F.col("__run") == most).drop("__bad", "__run")
    first = F.min_by(F.struct(*stops.columns), F.struct(*order)).alias("row")
    return stops.groupBy(F.col(group).alias("__g")).agg(first).select("row.*")


def complete_over(units: DataFrame, present: DataFrame, key: list[str], sensor: str, wanted: list[str]) -> DataFrame:
    """Units with the wanted sensors they lack, and whether they lack none."""
    have = present.filter(F.col(sensor).isin(wanted)).groupBy(*key).agg(F.collect_set(sensor).alias("__have"))
    missing = F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce("__have", F.array().cast("array<string>")))
    return units.join(have, key, "left").withColumn("missing", F.array_join(missing, ",")).withColumn("complete", F.col("missing") == "").drop("__have")
