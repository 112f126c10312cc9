"""Windowed activity over a stream of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(snapshots: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, operation, snapshots): snapshots by time of arrival and
    operation. Works on a stream, whose rows may come late by up to ``late``, and
    on a table alike."""
    timed = snapshots.withColumn("at", F.col("loaded_at").cast("timestamp"))
    counted = timed.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "operation").agg(F.count("*").alias("snapshots"))
    return counted.select(F.col("w.start").alias("window_start"), "operation", "snapshots")
