"""Rules for cases of daily records with intervals and sleeps: one row (rule, key, detail) per violation.

daily: case, day, wear, night_coverage, the metrics, missing map<metric, reason>. intervals: case, id, day, kind, start_at,
end_at. sleeps: case, id, day, start_at, end_at (the day is that of waking)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators import checks
from tideline.operators.intervals import by_day, gaps

#: Metrics by the time of day that makes them valid, and least minutes worn (fixed values).
DAY_METRICS = ("steps", "activity_duration_minutes", "low_movement_minutes")
NIGHT_METRICS = ("sleep_duration_minutes", "resting_heart_rate_bpm", "hrv_rmssd_ms")
LEAST_WEAR, LEAST_NIGHT, NIGHT_SHARE, DAY_MINUTES = 720, 180, 0.85, 1440
TOTALS = {"activity": "activity_duration_minutes", "low_movement": "low_movement_minutes"}


def minutes(start: str = "start_at", end: str = "end_at") -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 60e6


def noon_minutes(day: Column, ts: Column) -> Column:
    """Minutes since noon of the day before: no wrap-around at midnight."""
    return F.timestamp_diff("MICROSECOND", F.date_sub(day, 1).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS"), ts) / 60e6


def metric_violations(daily: DataFrame, sleeps: DataFrame) -> DataFrame:
    """Nulls and reasons, wear and night coverage, wake date, sleep against opportunity, and finite values."""
    metrics = [*DAY_METRICS, *NIGHT_METRICS]
    nights = sleeps.groupBy("case", "day").agg(F.sum(minutes()).alias("opportunity"), F.min("start_at").alias("sleep_from"), F.max("end_at").alias("sleep_to"))
    rows = daily.join(nights.hint("merge"), ["case", "day"], "left")  # rows per case and day: their number isn't seen from a table of cases, so they'd be broadcast
    unknown = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]))
    any_of = lambda names: reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in names])
    night = (F.col("night_coverage") >= LEAST_NIGHT) & (F.col("night_coverage") >= NIGHT_SHARE * F.col("opportunity"))
    finite = reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(F.col(m).cast("double")) & (F.abs(F.col(m)) < float("inf")), F.lit(True)) for m in metrics])
    at = lambda c: noon_minutes(F.col("day"), F.col(c))
    rules = {
        "reasons": F.array_sort(unknown) == F.array_sort(F.coalesce(F.map_keys("missing"), F.array().cast("array<string>"))), "finite": finite,
        "wear": F.coalesce(F.col("wear") >= LEAST_WEAR, F.lit(False)) | ~any_of(DAY_METRICS), "night": F.coalesce(night, F.lit(False)) | ~any_of(NIGHT_METRICS),
        "sleep length": F.coalesce(F.col("sleep_duration_minutes") <= F.col("opportunity"), F.lit(True)), "night coverage": F.coalesce(F.col("night_coverage") <= F.col("opportunity"), F.lit(True)),
        "wake date": F.col("opportunity").isNull() | ((F.to_date("sleep_to") == F.col("day")) & (F.col("opportunity") > 0) & (F.col("opportunity") <= DAY_MINUTES) & F.datediff(F.col("day"), F.to_date("sleep_from")).isin(0, 1)),
        "noon anchor": F.col("opportunity").isNull() | ((at("sleep_from") >= 0) & (at("sleep_from") < DAY_MINUTES) & (at("sleep_to") > 0) & (at("sleep_to") <= DAY_MINUTES)),
    }
    return checks.all_hold(rows, rules, ["case", "day"])


def overlapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id): intervals that begin before one that began earlier has ended."""
    reach = F.max("end_at").over(W.partitionBy(*keys).orderBy("start_at", "end_at", "id").rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("_reach", reach).where("start_at < _reach").select(*keys, "id")


def interval_violations(daily: DataFrame, intervals: DataFrame, sleeps: DataFrame) -> DataFrame:
    """Bounds within one day, order, sums against totals and wear, overlaps by day and by night, natural days over 24 hours."""
    inside = (F.col("start_at") < F.col("end_at")) & (F.to_date("start_at") == F.col("day")) & (F.col("end_at") <= F.date_add("day", 1).cast("timestamp_ntz"))
    sums = intervals.groupBy("case", "day").agg(*[F.sum(F.when(F.col("kind") == k, minutes())).alias(f"sum_{k}") for k in TOTALS], F.sum(minutes()).alias("sum_all"))
    rows = daily.join(sums.hint("merge"), ["case", "day"], "left")
    out = [checks.holds(intervals, "bounds", ["case", "id"], inside, F.col("kind")), checks.holds(rows, "wear sum", ["case", "day"], F.coalesce(F.col("sum_all") <= F.col("wear"), F.lit(True)), F.col("sum_all"))]
    for k, total in TOTALS.items():
        s, t = F.coalesce(f"sum_{k}", F.lit(0.0)), F.col(total)
        out.append(checks.holds(rows, f"{k} sum", ["case", "day"], F.when(t.isNull(), s == 0).otherwise(F.abs(s - t) <= 1e-7), s))
    for name, spans in (("day overlap", intervals), ("sleep overlap", sleeps)):
        out.append(checks.holds(overlapping(spans, ["case"]), name, ["case", "id"], F.lit(False), F.lit("overlaps")))
    from tideline.operators.intervals import overlaps

    both = overlaps(intervals.select("case", "id", "start_at", "end_at"), sleeps.select("case", "id", "start_at", "end_at"), ["case"])
    out.append(checks.holds(both, "day and night", ["case", "left_id"], F.lit(False), F.col("minutes")))
    nights = by_day(sleeps.select("case", "id", "start_at", "end_at")).groupBy("case", "day").agg(F.sum("minutes").alias("night"))
    full = daily.join(nights.hint("merge"), ["case", "day"], "left")
    out.append(checks.holds(full, "natural day", ["case", "day"], F.coalesce(F.col("wear") + F.coalesce("night", F.lit(0.0)) <= DAY_MINUTES + 1e-7, F.lit(True)), F.col("night")))
    return reduce(DataFrame.unionByName, out)


def calendar_violations(daily: DataFrame, periods: DataFrame) -> DataFrame:
    """Days that are missing, repeated or outside their period; periods (case, period, start, days), one after another."""
    want = periods.select("case", "period", F.explode(F.expr("sequence(start, date_add(start, cast(days as int) - 1))")).alias("day"))
    after = periods.withColumn("_due", F.lag(F.expr("date_add(start, cast(days as int))")).over(W.partitionBy("case").orderBy("start")))
    return reduce(DataFrame.unionByName, [
        checks.missing(daily, want, ["case", "day"]), checks.unexpected(daily, want, ["case", "day"]), checks.duplicates(daily, ["case", "day"]),
        checks.holds(after, "contiguous", ["case", "period"], F.col("_due").isNull() | (F.col("_due") == F.col("start")), F.col("start")),
    ])


def marginal_violations(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values that occur more often on one side than on the other within the keys: empty if the bags are equal."""
    count = lambda d, n: d.groupBy(*keys, value).agg(F.count("*").alias(n))
    a, b = count(left, "n"), count(right, "m").select(*[F.col(k).alias(f"_{k}") for k in [*keys, value]], "m")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, value]])
    both = a.join(b, same, "full_outer").select(*[F.coalesce(k, f"_{k}").alias(k) for k in [*keys, value]], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    return checks.holds(both, "multiset", [*keys, value], F.col("n") == F.col("m"), F.concat_ws(" <> ", F.col("n").cast("string"), F.col("m").cast("string")))


def gaps_without(spans: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap_start, gap_end) of the gaps between spans in which no inner interval lies whole. A gap meets the inner
    intervals of the days it touches only."""
    holes = gaps(spans, keys)
    days = holes.withColumn("day", F.explode(F.sequence(F.to_date("gap_start"), F.to_date("gap_end"))))
    own = inner.select(*keys, F.to_date("start_at").alias("day"), F.col("start_at").alias("_s"), F.col("end_at").alias("_e"))
    filled = days.join(own, [*keys, "day"]).where("_s >= gap_start AND _s < _e AND _e <= gap_end").select(*keys, "gap_start", "gap_end").distinct()
    return holes.join(filled, [*keys, "gap_start", "gap_end"], "left_anti")


def exposures(daily: DataFrame, intervals: DataFrame, value: str, below: float, hour: int = 20, least: float = 80.0) -> DataFrame:
    """Per case: days with a late long interval, and those of them after which the next day's value is low."""
    late = intervals.where((F.hour("start_at") >= hour) & (minutes() >= least)).select("case", "day").distinct()
    after = daily.select("case", F.date_sub("day", 1).alias("day"), F.col(value).alias("_v"))
    return late.join(after, ["case", "day"], "left").groupBy("case").agg(F.count("*").alias("exposed"), F.count_if(F.col("_v") < below).alias("followed"))


def quota_violations(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose number of rows differs from the expected ``n``, groups on one side only included."""
    found = df.groupBy(*keys).agg(F.count("*").alias("found"))
    return checks.holds(expected.join(found, keys, "full_outer"), "quota", keys, F.coalesce("found", F.lit(0)) == F.coalesce("n", F.lit(0)), F.coalesce("found", F.lit(0)))


def overview(violations: dict[str, DataFrame]) -> DataFrame:
    """(stage, rule, violations) of all stages; nothing stops at the first failure. No row: complete."""
    return reduce(DataFrame.unionByName, [v.groupBy("rule").agg(F.count("*").alias("violations")).select(F.lit(n).alias("stage"), "rule", "violations") for n, v in violations.items()])
