"""Streaming analogue of forward windows. An extension: the batch operators need finished sequences, and backward windows,
anchored at a sequence's end, have no streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, window: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """event_type, win_start, win_end, n, total over sliding event-time windows, with a watermark; works on batch frames too."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", window, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n", "total")
