"""A streaming twin of interval union: activity of a user as session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``user_id, start, end, n_events`` of events (``ts`` TIMESTAMP) that follow each other
    within the gap. Works on batches and streams; a stream emits a session once the watermark
    has passed it, and drops events that are later than ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
