"""Windowed counts over a stream: an extension, since batch tables are what the package is about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Events by window and key. ``late`` is how long a window stays open for stragglers, which bounds the state kept.

    Works on batch tables alike (there the watermark has no effect).
    """
    window = F.window(time, width)
    counted = events.withWatermark(time, late).groupBy(window, key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n")
