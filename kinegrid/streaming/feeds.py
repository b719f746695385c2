"""A pose feed as a stream: speeds per window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_positions(feed: DataFrame, *, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(session_id, window, n, x, y): mean positions of each window; feed: session_id, ts, x, y. Works on batches as well."""
    rows = feed.withWatermark("ts", late) if feed.isStreaming else feed
    return rows.groupBy("session_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
