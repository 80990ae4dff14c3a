"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have before an equi-join falls back from broadcast to a shuffle join.
BROADCAST_ROWS = 200_000
#: And its bytes, written as JSON text.
BROADCAST_BYTES = 32_000_000


def build_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local UTC session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Respect spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster must name a shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(configured or Path(tempfile.mkdtemp(prefix="spark-")).as_uri())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once, with a hint for broadcast only if its rows and their size as text are within bounds.

    The written rows are measured and joined, so its plan runs once. A larger side comes back without a hint
    and takes part in a shuffle join.
    """
    held = cut_lineage(df)
    size = held.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(held) if size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes else held
