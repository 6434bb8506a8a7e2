"""Streams of events and state over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and sums by window and key; rows later than ``late`` are dropped, and state older than that is too."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "events", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after ``gap`` without an event."""
    out = events.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap)).agg(F.count("*").alias("events"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def once(events: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """Each key once; a repeat is recognised as long as the watermark keeps the key."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def upsert_batches(stream: DataFrame, warehouse, name: str, keys: list[str], content: list[str], checkpoint: str, position: str = ""):
    """A streaming query that hands each micro-batch to the versioned upsert. A batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        warehouse.upsert(batch, name, keys, content, f"batch-{number}", position=position)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
