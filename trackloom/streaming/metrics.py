"""Metrics over an event stream: tumbling windows with a watermark, and counters that never expire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """Events and their sum for each window and name; rows later than ``late`` are dropped and state is bounded."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "events", "total")


def distinct_sessions(events: DataFrame, session: str = "user_id", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The first event of each session in each window."""
    return events.withWatermark("ts", late).withColumn("w", F.window("ts", width)).dropDuplicatesWithinWatermark(["w", session]).select(F.col("w.start").alias("window_start"), session)


def counters(events: DataFrame, by: str = "event_type") -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("total"))


def drain(result: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Run a stream to its present end into an in-memory table, for tests and small results."""
    writer = result.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
