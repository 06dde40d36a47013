"""Streams of the same operators: windowed counts and per-key running state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per time window; rows later than ``late`` are dropped by the watermark."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    d = events.withWatermark(at, late).groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return d.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "value")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Bursts of a key with no pause above ``gap``."""
    d = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return d.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def once(events: DataFrame, at: str, id_: str, late: str) -> DataFrame:
    """Each event once, whatever the source delivers again within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([id_])
