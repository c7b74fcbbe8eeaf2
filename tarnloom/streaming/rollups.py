"""Streaming forms of the roll-ups over events. The batch forms are the compared ones; these are an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_roll_up(events: DataFrame, tau: float, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, mean, min and retention of each event type in tumbling windows; works on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean_value"), F.min("value").alias("min_value"), F.avg(F.when(F.col("value") >= tau, 1.0).when(F.col("value").isNotNull(), 0.0)).alias("retention"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value", "min_value", "retention")


def stream_events(spark: SparkSession, path: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").option("pathGlobFilter", pattern).parquet(path)
