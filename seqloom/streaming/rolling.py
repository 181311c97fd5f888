"""Rolling decision windows over an observation stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_windows(events: DataFrame, ts: str, keys: list[str], value: str, window: str = "10 seconds", stride: str = "500 milliseconds", late: str = "30 seconds") -> DataFrame:
    """Count, mean and maximum of a value in sliding windows, per key; events later than
    ``late`` are dropped.  Works on streams and on batches."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, window, stride), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "max")


def bursts(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of events with no pause longer than ``gap``."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
