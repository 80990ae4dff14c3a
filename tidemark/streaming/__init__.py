"""Incremental forms of the batch operators: new readings to bins, gaps by session, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.sinks import exists


def windowed_means(readings: DataFrame, width: str, late: str) -> DataFrame:
    """Tumbling means per station over a stream with a watermark; a batch gives the same rows."""
    rows = readings.filter("ts is not null")
    timed = rows.withWatermark("ts", late) if rows.isStreaming else rows
    bins = timed.groupBy("station_id", F.window("ts", width)).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return bins.select("station_id", F.col("window.start").alias("bin"), "value", "n")


def reading_sessions(readings: DataFrame, gap: str, late: str) -> DataFrame:
    """Stretches of readings no further apart than ``gap``: what lies between two of a station is a gap."""
    rows = readings.filter("ts is not null and value is not null")
    timed = rows.withWatermark("ts", late) if rows.isStreaming else rows
    got = timed.groupBy("station_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return got.select("station_id", F.col("w.start").alias("first_ts"), "last_ts", "n")


def append_available(stream: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends what has arrived and ends; rows whose keys are already in the folder are skipped, so a rerun adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys)
        spark = batch.sparkSession
        if exists(spark, folder):  # any other trouble with reading it ends the batch, rather than appending all again
            fresh = fresh.join(spark.read.parquet(folder).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
