"""Streams of events and pages: windows with late data, sessions, deduplication, first evidence.

Each function takes a streaming or a batch DataFrame; with a batch one the watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of windows of the given size, sliding if asked."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a longer gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_arrivals(pages: DataFrame, key: str = "url", late: str = "1 hour") -> DataFrame:
    """Rows whose key has not arrived within the watermark's reach."""
    if pages.isStreaming:
        return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return pages.dropDuplicates([key])


def properties(events: DataFrame) -> DataFrame:
    """(event_type, k, n) from the JSON properties; unreadable ones have no k."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))
