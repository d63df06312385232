"""Tumbling counts and session windows, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and their values by window and type; works on batches and on watermarked streams."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessionize(events: DataFrame, gap: str = "6 hours", key: str = "user_id") -> DataFrame:
    """Sessions of a key: they end when nothing came for the gap."""
    return events.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def event_stream(spark, path: str, schema, late: str = "1 hour") -> DataFrame:
    """A stream of event files with a watermark; ts becomes a timestamp with a zone, as watermarks ask for."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def distinct_events(stream: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return stream.dropDuplicatesWithinWatermark([id_col])
