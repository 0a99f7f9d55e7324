"""Incremental daily statistics: the batch aggregate as a stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(events: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """Count and sum per key and day; works on a stream (append mode, after the watermark) and on a table alike."""
    rows = events.withColumn("at", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    out = rows.groupBy(*keys, F.window("at", "1 day")).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return out.select(*keys, F.to_date("window.start").alias("day"), "events", "total")
