"""Event streams: rates in windows with late events, and coincidences in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Event files that arrive in a folder, as a stream."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def event_rate(events: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(start, n, value): events and their values by tumbling window; later ones than the watermark are dropped."""
    by = events.withWatermark("ts", lateness).groupBy(F.window("ts", window))
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "n", "value")


def coincidences(first: DataFrame, second: DataFrame, gap: str = "5 seconds", lateness: str = "1 hour") -> DataFrame:
    """(a, b): events of the same user in both streams no more than ``gap`` apart."""
    a = first.select(F.col("event_id").alias("a"), F.col("ts").alias("ta"), F.col("user_id").alias("ua")).withWatermark("ta", lateness)
    b = second.select(F.col("event_id").alias("b"), F.col("ts").alias("tb"), F.col("user_id").alias("ub")).withWatermark("tb", lateness)
    near = F.expr(f"ua = ub AND tb >= ta - INTERVAL {gap} AND tb <= ta + INTERVAL {gap}")
    return a.join(b, near).select("a", "b")
