"""Landed gauge data as typed tables: readings, daily levels, header metadata, station overview, polygons.

Null, NaN and infinite levels are null in every canonical table; rows with unusable times are kept by
``typed_readings`` (with a null ``ts``) and dropped and counted by its callers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timestamps import to_instants

GOOD_CODE = 254
LOW, HIGH = 0.0, 125.0


def finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def truth(c: str) -> Column:
    """true/false in any case, trimmed; anything else is null."""
    word = F.lower(F.trim(c))
    return F.when(word == "true", True).when(word == "false", False)


def utc_time(micros: str) -> Column:
    """UTC time without zone of microseconds since 1970, whatever the session's zone."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col(micros) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def typed_codes(raw: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The rows with station_id, value (null outside low..high), quality_code (0 where missing), quality_ok and flag."""
    value = F.when(F.col("value").between(low, high), F.col("value"))
    code = F.coalesce("quality_code", F.lit(0))
    return raw.select(
        "reading_id", "file_id", F.col("station_ref").alias("station_id"), *[c for c in ("utc_us",) if c in raw.columns], value.alias("value"),
        code.alias("quality_code"), (code == GOOD_CODE).alias("quality_ok"), truth("quality_ok").alias("flag"),
    )


def typed_readings(raw: DataFrame, files: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """typed_codes with ts, the UTC time of every notation (null where the text denotes no instant)."""
    return typed_codes(to_instants(raw, files), low, high).withColumn("ts", utc_time("utc_us")).drop("utc_us")


def daily_levels(labels: DataFrame) -> DataFrame:
    """station_id, day and value, one row per station and day; repeated rows count once."""
    level = F.when(F.col("mean_level").between(LOW, HIGH), F.col("mean_level"))
    return labels.filter("station_id is not null and label_date is not null").groupBy(
        "station_id", F.col("label_date").alias("day")
    ).agg(F.max(level).alias("value"))


def header_metadata(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The approved ``#key;value`` header lines of each file as columns; others are dropped, the last of repeats wins."""
    text = F.regexp_replace("line", "^﻿", "")
    pairs = lines.filter(F.trim(text).startswith("#")).select(
        "file_id", "line_no", F.lower(F.trim(F.regexp_extract(text, r"^\s*#\s*([^;]*);", 1))).alias("key"),
        F.trim(F.regexp_extract(text, r"^[^;]*;(.*)$", 1)).alias("cell"),
    )
    return pairs.groupBy("file_id").agg(*[F.max_by(F.when(F.col("key") == k, F.col("cell")), F.when(F.col("key") == k, F.col("line_no"))).alias(k) for k in keys])


def station_of_file(name: str) -> Column:
    """Digits of a file name of the form wl_<station>_<n>.csv."""
    return F.nullif(F.regexp_extract(name, r"^wl_(\d+)_\d+\.csv$", 1), F.lit(""))


def area_number(c: str) -> Column:
    """The number in a text such as '148.00 km²', null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, "km²", ""), r"[^\d.]", ""), F.lit("")).try_cast("double")


def preferred_file(files: DataFrame, station: str, name: str, patterns: list[str]) -> DataFrame:
    """The file of each station whose name matches the first of the patterns that any of its files matches; ties go to the name.

    Patterns may hold ``{station}``; a station without a match has no row.
    """
    matches = [F.regexp_like(F.col(name), F.replace(F.lit(p), F.lit("{station}"), F.col(station))) for p in patterns]
    rank = F.coalesce(*[F.when(m, k) for k, m in enumerate(matches)])
    ranked = files.withColumn("__rank", rank).filter("__rank is not null")
    best = F.min_by(F.struct(*files.columns, F.col("__rank").alias("priority")), F.struct("__rank", name)).alias("row")
    return ranked.groupBy(F.col(station).alias("__st")).agg(best).select("row.*")
