"""Event rates on streams: windows with late data, duplicates, and sessions of close events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, time: str = "ts", key: str = "user_id", width: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and means per window and key; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time, width)
    return (events.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), key, "n", "mean"))


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Groups of events of a key with no longer pause than ``gap``."""
    return (events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("s.start").alias("start"), F.col("s.end").alias("stop"), key, "n"))


def distinct_events(events: DataFrame, ident: str = "event_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([ident])
