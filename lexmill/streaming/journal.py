"""Append-only journals as streams: duplicates within a watermark, windowed counts of what resumed runs still owe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream without repeats of a key within the watermark; state is dropped behind it."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def per_window(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in each window; a window is emitted once the watermark has passed it."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def still_to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has left."""
    return wanted.join(done.where("status = 'ok'").select(key).distinct(), key, "left_anti")
