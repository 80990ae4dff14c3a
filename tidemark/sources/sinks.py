"""Sinks: partitioned tables, verified replacement, wide panels and JSON reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, folder: str, by: list[str], mode: str = "overwrite") -> None:
    """One folder per key, so that readers of a station or a year prune the rest."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).option("compression", "zstd").parquet(folder)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    system, path = _files(spark, folder)
    return system.exists(path(folder))


def verified_replace(df: DataFrame, folder: str, check: Callable[[DataFrame], str | None]) -> str | None:
    """Writes beside the folder, verifies what was written and only then renames it into place; returns the objection if there is one.

    The old table is renamed away first, renamed back if the new one can't take its place, and deleted last;
    on an objection only the new one is deleted. No data is copied, so nothing is ever half there.
    """
    spark, target = df.sparkSession, folder.rstrip("/")
    staging, old = f"{target}.staging", f"{target}.old"
    system, path = _files(spark, target)
    if not system.exists(path(target)) and system.exists(path(old)):  # an earlier run ended between its two renames
        system.rename(path(old), path(target))
    df.write.mode("overwrite").parquet(staging)
    if objection := check(spark.read.parquet(staging)):
        system.delete(path(staging), True)
        return objection
    system.delete(path(old), True)
    had = system.exists(path(target))
    if had and not system.rename(path(target), path(old)):
        raise OSError(f"can't rename {target}")
    if not system.rename(path(staging), path(target)):
        if had:
            system.rename(path(old), path(target))
        raise OSError(f"can't rename {staging}")
    system.delete(path(old), True)
    return None


def wide_panel(long: DataFrame, time: str, station: str, value: str, stations: list[str]) -> DataFrame:
    """Stations as columns, for a list that is known beforehand; the long form stays the stored one."""
    return long.groupBy(time).pivot(station, stations).agg(F.first(value))


def json_report(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
