"""Streaming ingest of event files. An extension: micro-batches over the same functions the batch side uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def unique(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events once each, state kept for the watermark's length."""
    return events.withColumn(ts, events[ts].cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, size: str = "1 day", ts: str = "ts") -> DataFrame:
    """start, event_type, n, total. Works on streams (with a watermark) and on tables."""
    agg = events.groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, ts: str = "ts") -> DataFrame:
    agg = events.groupBy(F.window(ts, size, step)).agg(F.count("*").alias("n"))
    return agg.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    agg = events.groupBy(F.session_window(ts, gap), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), "n")
