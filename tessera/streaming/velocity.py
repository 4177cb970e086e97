"""Extension beyond the batch pipeline: event velocity per user as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_velocity(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per user and window; works on a stream (late events beyond the watermark are left out) and on a table."""
    ts = F.col("ts").cast("timestamp")
    timed = events.withColumn("ts", ts)
    held = timed.withWatermark("ts", late) if events.isStreaming else timed
    return held.groupBy(F.window("ts", window), "user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "user_id", "events", "value")
