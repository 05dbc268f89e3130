"""Cutting lineage on shared storage, and size checks before broadcasting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tablerisk-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add the broadcast hint only if the frame is known to have at most ``rows`` rows."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df


def stored_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a reduced join side once, store it, and broadcast it if it turned out small."""
    return broadcast_if_small(durable(df), rows)
