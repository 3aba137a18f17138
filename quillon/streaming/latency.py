"""Latency per method over tumbling windows, from a stream of events (ts, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and maximum per window and type; events later than the watermark are dropped. Works on batches too."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    got = seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return got.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"), "max_value")


def start(events: DataFrame, path: str, checkpoint: str, **how):
    """Writes finished windows to Parquet."""
    return latency(events, **how).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
