"""Upkeep of popularity under a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_popularity(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts of items by type in tumbling windows of event time ``ts``; events later than ``delay`` are dropped."""
    e = events.withWatermark("ts", delay)
    c = e.groupBy(F.window("ts", window).alias("w"), "type", "aid").agg(F.count("*").alias("cnt"))
    return c.select(F.col("w.start").alias("start"), "type", "aid", "cnt")


def start(counts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append closed windows to a Parquet table, exactly once."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def popularity(windows: DataFrame, since=None) -> DataFrame:
    """``type, aid, cnt`` of the windows kept, from ``since`` on."""
    w = windows if since is None else windows.where(F.col("start") >= F.lit(since))
    return w.groupBy("type", "aid").agg(F.sum("cnt").alias("cnt"))
