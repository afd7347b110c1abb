"""Counters, gauges, timers and usage figures over a table of events (name, ts, value, session)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(events: DataFrame, by: list[str], value: Column | None = None) -> DataFrame:
    return events.groupBy(*by).agg(F.sum(F.lit(1) if value is None else value).alias("total"))


def gauges(events: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each name."""
    last = F.max(F.struct(*order, value))
    return events.groupBy(*by).agg(last.alias("x")).select(*by, F.col(f"x.{value}").alias("value"))


def last_n(events: DataFrame, by: list[str], order: list[Column], n: int = 1000) -> DataFrame:
    """The last ``n`` rows of each name: a rank filter, which Spark limits before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return events.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def sample_stats(events: DataFrame, by: list[str], value: str, order: list[Column], n: int = 1000) -> DataFrame:
    v = F.col(value)
    return last_n(events, by, order, n).groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"))


def performance(events: DataFrame, duration: str, failed: Column, order: list[Column], n: int = 100) -> DataFrame:
    """One row: response times of the last ``n`` requests; requests, errors and their rate over all."""
    v = F.col(duration)
    times = events.orderBy(*order).limit(n).agg(F.avg(v).alias("avg_response_time"), F.min(v).alias("min_response_time"), F.max(v).alias("max_response_time"))
    rates = events.agg(F.count(F.lit(1)).alias("total_requests"), F.count_if(failed).alias("error_count"), F.coalesce(F.avg(failed.cast("double")), F.lit(0.0)).alias("error_rate"))
    return times.join(rates)  # one row each


def usage(events: DataFrame, by: str, session: str) -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("uses"), F.count_distinct(session).alias("sessions"))


def error_frequency(events: DataFrame, kind: Column, message: Column) -> DataFrame:
    return events.groupBy(F.concat_ws(":", kind, message).alias("error")).agg(F.count(F.lit(1)).alias("times"))


def tumbling(events: DataFrame, width: str, by: str, value: str) -> DataFrame:
    """Count and sum for each window and name; the batch form of ``streaming.metrics``."""
    return events.groupBy(F.window("ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "events", "total")
