"""[ext] Usage as a stream (IN6); the reference has no streaming.  Events are ``(event_id, ts, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    """Event times as instants, with a watermark where the events are a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", watermark) if events.isStreaming else events


def daily_counts(events: DataFrame, watermark: str = "1 day", by: str = "event_type") -> DataFrame:
    """Events by day and type; with a stream, rows later than the watermark are dropped."""
    rows = _timed(events, watermark)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), by, "n")


def sliding_counts(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", watermark: str = "1 day") -> DataFrame:
    rows = _timed(events, watermark)
    return rows.groupBy(F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", watermark: str = "1 day") -> DataFrame:
    rows = _timed(events, watermark)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, "w.start", "w.end", "n")


def once(events: DataFrame, key: str = "event_id", watermark: str = "1 day") -> DataFrame:
    """Each event once, within the watermark."""
    rows = _timed(events, watermark)
    return rows.dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])
