"""Growing recordings as streams: new files' lines, and working stretches by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of files that arrive in a folder, with their file; malformed ones have ``ok`` false."""
    raw = spark.readStream.format("text").option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").isNotNull().alias("ok"))


def stretches(events: DataFrame, idle: str = "45 minutes", late: str = "1 hour") -> DataFrame:
    """Working stretches of each session as a stream, by event time.

    Unlike ``turns.stretches`` a gap of exactly ``idle`` ends a stretch, and order is by time, not by
    record; what comes more than ``late`` after the newest stamp is dropped, as watermarks do.
    """
    windowed = events.withWatermark("ts", late).groupBy("harness", "session", F.session_window("ts", idle))
    return windowed.agg(F.count("*").alias("turns"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("session_window")
