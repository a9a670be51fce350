"""Event-time statistics over a stream of events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped by the engine."""
    return _timed(events, late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
