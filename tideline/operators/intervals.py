"""Intervals [start_at, end_at): range joins over day buckets, so that no nested loop is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_day(spans: DataFrame, start: str = "start_at", end: str = "end_at") -> DataFrame:
    """One row per interval and calendar day that it touches, with the minutes inside that day."""
    last = F.to_date(F.greatest(F.col(end) - F.expr("INTERVAL 1 MICROSECOND"), F.col(start)))
    rows = spans.withColumn("day", F.explode(F.sequence(F.to_date(F.col(start)), last)))
    lo = F.greatest(F.col(start), F.col("day").cast("timestamp_ntz"))
    hi = F.least(F.col(end), F.date_add("day", 1).cast("timestamp_ntz"))
    return rows.withColumn("minutes", F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", lo, hi) / 60e6))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """(keys, left_id, right_id, minutes) of overlapping pairs; each pair once, on the day its overlap begins."""
    side = lambda d, n: by_day(d).select(*keys, "day", F.col(id_).alias(f"{n}_id"), F.col("start_at").alias(f"{n}_s"), F.col("end_at").alias(f"{n}_e"))
    both = side(left, "left").join(side(right, "right"), [*keys, "day"])
    lo, hi = F.greatest("left_s", "right_s"), F.least("left_e", "right_e")
    return both.where((lo < hi) & (F.to_date(lo) == F.col("day"))).select(*keys, "left_id", "right_id", (F.timestamp_diff("MICROSECOND", lo, hi) / 60e6).alias("minutes"))


def gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap_start, gap_end): uncovered time between the intervals of a key."""
    w = W.partitionBy(*keys).orderBy("start_at", "end_at")
    reach = F.max("end_at").over(w.rowsBetween(W.unboundedPreceding, 0))
    return spans.withColumn("gap_start", reach).withColumn("gap_end", F.lead("start_at").over(w)).where("gap_end > gap_start").select(*keys, "gap_start", "gap_end")
