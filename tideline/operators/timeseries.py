"""Calendar statistics over (keys, day, value): missing days stay null, lags follow the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def totals(rows: DataFrame, keys: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Sums per group, and its rows as ``events``. Doubles are added in the given order, which should leave open the place of equal
    values only: a sum is the same however the rows are dealt out, and so is what compares sums. A running window spills, so that
    a large group is one task's time, but not its memory."""
    w = W.partitionBy(*keys).orderBy(*order)
    running = rows.select(*keys, F.row_number().over(w).alias("_n"), *[F.sum(c).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(k) for k, c in sums.items()])
    return running.groupBy(*keys).agg(F.count("*").alias("events"), *[F.max_by(k, "_n").alias(k) for k in sums])


def densify(daily: DataFrame, keys: list[str], start, end, day: str = "day") -> DataFrame:
    """Every day from start to end for every key; days without a row have null values."""
    days = daily.select(*keys).distinct().withColumn(day, F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return days.join(daily, [*keys, day], "left")


def describe(daily: DataFrame, keys: list[str], value: str = "value", day: str = "day") -> DataFrame:
    """Counts, mean, median, population variance, extrema and slope per calendar day of the non-null values."""
    x = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")
    y = F.col(value)
    seen = F.when(y.isNotNull(), x)
    slope = F.covar_pop(seen, y) / F.nullif(F.var_pop(seen), F.lit(0.0))
    return daily.groupBy(*keys).agg(
        F.count(value).alias("valid_count"), F.count_if(y.isNull()).alias("missing_count"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.var_pop(value).alias("variance"), F.min(value).alias("min"), F.max(value).alias("max"), slope.alias("slope"),
    )


def lagged(daily: DataFrame, keys: list[str], lag: int, left: str, right: str, day: str = "day") -> DataFrame:
    """(keys, day, x, y): left's value on a day and right's ``lag`` calendar days later, both non-null."""
    a = daily.select(*keys, F.col(day), F.col(left).alias("x")).where("x IS NOT NULL")
    b = daily.select(*keys, F.date_add(F.col(day), -lag).alias(day), F.col(right).alias("y")).where("y IS NOT NULL")
    return a.join(b, [*keys, day])


def pearson(x: str = "x", y: str = "y", least: int = 3) -> Column:
    """Correlation as an aggregate: null under ``least`` pairs or without variance, cut to -1..1."""
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(F.count("*") >= least, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def phase(day: Column, start, days: int, baseline: int) -> tuple[Column, Column]:
    """(block, phase) of a day: blocks of ``days`` from start, the first ``baseline`` days of each being the baseline."""
    n = F.datediff(day, F.lit(start).cast("date"))
    return F.floor(n / days).cast("int"), F.when(F.pmod(n, F.lit(days)) < baseline, "baseline").otherwise("current")


def longest_run(daily: DataFrame, keys: list[str], holds: Column, day: str = "day") -> DataFrame:
    """Longest run of consecutive days on which ``holds`` is true; false, null and absent days break it."""
    rows = daily.where(holds).select(*keys, day).distinct()
    island = F.date_add(F.col(day), -F.row_number().over(W.partitionBy(*keys).orderBy(day)))
    runs = rows.withColumn("island", island).groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest_run_days"))


def circular(minute: Column, period: float = 1440.0) -> tuple[Column, Column]:
    """(mean minute, resultant length) of times of day as aggregates."""
    a = minute * (2 * 3.141592653589793 / period)
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    return F.pmod(F.atan2(s, c) * (period / (2 * 3.141592653589793)), F.lit(period)), F.sqrt(s * s + c * c)
