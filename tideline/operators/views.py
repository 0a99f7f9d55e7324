"""Views of a case: statistics per phase and their text, daily frames with stated dates, families of facts, and shares of cases.

Measurements come in long form: (keys, n, metric, value), n being the number of the day in its case, from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Monday from which dates that keep only the weekday are counted (fixed value).
ANCHOR = "2000-01-03"
#: Modes of a view (fixed values).
MODES = ("current", "statistics", "full")


def view(long: DataFrame, keys: list[str], mode: str, baseline: int, zero_is_missing: tuple[str, ...] = ()) -> DataFrame:
    """What a mode shows of a case. full: all rows; statistics: those of both phases; current: those after day ``baseline``.

    Statistics are (keys, phase, metric, first_day, last_day, n, missing, mean, median, sd, min, max, slope_per_day,
    adjacent_change). Nulls, and zeros of the metrics in ``zero_is_missing``, count as missing. A metric without values has
    null statistics. The adjacent change is the mean absolute one between days that follow each other."""
    if mode not in MODES:
        raise ValueError(f"{mode} instead of one of {MODES}")
    if mode == "full":
        return long.select(*keys, "n", "metric", "value")
    rows = long if mode == "statistics" else long.where(F.col("n") > baseline)
    unusable = F.col("metric").isin(*zero_is_missing) & (F.col("value") == 0)
    rows = rows.withColumn("phase", F.when(F.col("n") <= baseline, "baseline").otherwise("current")).withColumn("value", F.when(~unusable, F.col("value")))
    by = [*keys, "phase", "metric"]
    w = W.partitionBy(*by).orderBy("n")
    rows = rows.withColumn("step", F.when(F.col("n") - F.lag("n").over(w) == 1, F.abs(F.col("value") - F.lag("value").over(w))))
    day = F.when(F.col("value").isNotNull(), F.col("n").cast("double"))
    return rows.groupBy(*by).agg(
        F.min("n").alias("first_day"), F.max("n").alias("last_day"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.covar_pop(day, "value") / F.nullif(F.var_pop(day), F.lit(0.0))).alias("slope_per_day"), F.avg("step").alias("adjacent_change"))


def two_places(value: Column) -> Column:
    """A number with one or two decimals, "unknown" if null. Halves of the ninth decimal's form go up."""
    text = value.cast("decimal(30,9)").cast("decimal(30,2)").cast("string")
    return F.coalesce(F.regexp_replace(text, "0$", ""), F.lit("unknown"))


def query_text(statistics: DataFrame, keys: list[str], opening: str, closing: str) -> DataFrame:
    """(keys, text): a line per phase and metric, in order of their names, between two given lines. A phase's days are those of
    all its metrics."""
    line = F.concat(F.translate("metric", "_", " "), F.lit(": n="), F.col("n").cast("string"), F.lit(" mean="), two_places(F.col("mean")),
                    F.lit(" sd="), two_places(F.col("sd")), F.lit(" slope/day="), two_places(F.col("slope_per_day")))
    phases = statistics.groupBy(*keys, "phase").agg(F.min("first_day").alias("a"), F.max("last_day").alias("b"), F.array_sort(F.collect_list(F.struct("metric", line.alias("line")))).alias("lines"))
    head = F.concat(F.col("phase"), F.lit(" days ["), F.col("a").cast("string"), F.lit(", "), F.col("b").cast("string"), F.lit("]"))
    part = F.concat_ws("\n", head, F.transform("lines", lambda x: x.line))
    cases = phases.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("phase", part.alias("part")))).alias("parts"))
    return cases.select(*keys, F.concat_ws("\n", F.lit(opening), F.transform("parts", lambda x: x.part), F.lit(closing)).alias("text"))


def dated(days: DataFrame, keys: list[str], n: str = "n", weekday: str = "weekday") -> DataFrame:
    """Adds ``date``: a made-up one on which the case's first day has its true weekday (1: Monday)."""
    first = F.first(weekday).over(W.partitionBy(*keys).orderBy(n))
    return days.withColumn("date", F.date_add(F.lit(ANCHOR).cast("date"), (first - 1 + F.col(n) - 1).cast("int")))


def clock_at(date: Column, offset: Column, clock: Column) -> Column:
    """Time stamp of a clock time (HH:mm:ss) on the day ``offset`` days after a date; null if any of them is."""
    return F.to_timestamp(F.concat(F.date_add(date, offset.cast("int")).cast("string"), F.lit(" "), clock), "yyyy-MM-dd HH:mm:ss")


def facts(long: DataFrame, timed: DataFrame, spans: DataFrame, evenings: DataFrame, keys: list[str], first: int, half: int, weekend: Column, following: str, high: str, low: str) -> DataFrame:
    """(keys, family, metric, name, value): seven families of plain arithmetic on a case, the window being the days from ``first``.

    Means before and in the window, of its first ``half`` days and the rest, of weekdays and weekends; missing days; earliest and
    latest of ``timed`` (keys, n, metric, minute: from noon); mean of the days' longest ``spans`` (keys, n, metric, minutes);
    ``following``'s mean on days after ``evenings`` (keys, n) and after others; days on which ``high`` is above its highest
    and ``low`` below its lowest value before the window. A metric without values in the window gets no means."""
    inside = F.col("n") >= first

    def listed(df: DataFrame, metric, families: dict[str, dict[str, Column]]) -> DataFrame:
        each = [F.struct(F.lit(f).alias("family"), F.lit(name).alias("name"), c.cast("double").alias("value")) for f, named in families.items() for name, c in named.items()]
        return df.select(*keys, metric, F.explode(F.array(*each)).alias("x")).select(*keys, "x.family", "metric", "x.name", "x.value")

    mean = lambda condition: F.avg(F.when(condition, F.col("value")))
    second = F.col("n") >= first + half
    means = long.groupBy(*keys, "metric").agg(
        mean(~inside).alias("b"), mean(inside).alias("w"), mean(inside & ~second).alias("h1"), mean(second).alias("h2"),
        mean(inside & ~weekend).alias("d"), mean(inside & weekend).alias("e"), F.count_if(inside & F.col("value").isNull()).alias("gone"))
    col = F.col
    out = [
        listed(means.where("w IS NOT NULL"), col("metric"), {
            "baseline_comparison": {"baseline_mean": col("b"), "window_mean": col("w"), "mean_difference": col("w") - col("b")},
            "ordered_halves": {"first_mean": col("h1"), "last_mean": col("h2")}, "day_groups": {"weekday_mean": col("d"), "weekend_mean": col("e")}}),
        listed(means.where("w IS NOT NULL AND gone > 0"), col("metric"), {"missing": {"missing_days": col("gone")}}),
    ]
    times = timed.where(inside & F.col("minute").isNotNull()).groupBy(*keys, "metric").agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    out.append(listed(times, col("metric"), {"sleep_timing": {"earliest": col("a"), "latest": col("b"), "range": col("b") - col("a")}}))
    longest = spans.where(inside).groupBy(*keys, "metric", "n").agg(F.max("minutes").alias("longest")).groupBy(*keys, "metric").agg(F.avg("longest").alias("m"))
    out.append(listed(longest.where("m IS NOT NULL"), col("metric"), {"interval_structure": {"mean_longest_minutes": col("m")}}))
    marks = evenings.where(inside).select(*keys, "n").distinct().withColumn("late", F.lit(True))
    days = long.where(inside & (F.col("metric") == following)).join(marks, [*keys, "n"], "left").select(*keys, "n", "value", F.coalesce("late", F.lit(False)).alias("late"))
    w = W.partitionBy(*keys).orderBy("n")
    days = days.withColumn("next", F.when(F.lead("n").over(w) == F.col("n") + 1, F.lead("value").over(w)))
    after = days.groupBy(*keys).agg(F.max("late").alias("any"), F.avg(F.when(F.col("late"), F.col("next"))).alias("a"), F.avg(F.when(~F.col("late"), F.col("next"))).alias("b"))
    out.append(listed(after.where("any"), F.lit(following).alias("metric"), {"lag_alignment": {"mean_after_evening": col("a"), "mean_after_other": col("b")}}))
    wide = long.where(F.col("metric").isin(high, low)).groupBy(*keys, "n").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(name) for m, name in ((high, "x"), (low, "y"))])
    of_case = W.partitionBy(*keys)
    wide = wide.withColumn("top", F.max(F.when(~inside, F.col("x"))).over(of_case)).withColumn("bottom", F.min(F.when(~inside, F.col("y"))).over(of_case)).where("top IS NOT NULL AND bottom IS NOT NULL")
    above, below = inside & (F.col("x") > F.col("top")), inside & (F.col("y") < F.col("bottom"))
    shared = wide.groupBy(*keys).agg(F.count_if(above).alias("a"), F.count_if(below).alias("b"), F.count_if(above & below).alias("c"))
    out.append(listed(shared, F.lit(high).alias("metric"), {"date_overlap": {"days_above": col("a"), "days_below": col("b"), "days_both": col("c")}}))
    return reduce(DataFrame.unionByName, out)


def descriptive(cases: DataFrame, resolved: DataFrame, case: str = "case_id") -> DataFrame:
    """One row of counts and shares of all cases. resolved: (case, priority, top_outcome, items, pairs), the two last being arrays
    of labels. While a case is unresolved all shares are null; without cases too."""
    rows = cases.select(case).distinct().join(resolved.withColumn("done", F.lit(True)), case, "left")
    has = lambda c, label: F.coalesce(F.array_contains(c, label), F.lit(False))
    unsure = F.col("top_outcome") == "insufficient_information"
    clear = (F.col("priority") == "clear") & ~unsure
    several = F.size(F.filter("items", lambda x: x == "applicable")) >= 2
    out = rows.agg(
        F.count("*").alias("cases"), F.count_if(F.col("done").isNull()).alias("unresolved"), F.count_if(several).alias("multi_applicable"),
        F.count_if(clear).alias("clear"), F.count_if(clear & several).alias("multi_clear"),
        F.count_if(F.col("top_outcome").isin("unique_best", "tied_best")).alias("decidable"),
        F.count_if(has("items", "insufficient_information") | has("pairs", "insufficient_information") | F.coalesce(unsure, F.lit(False))).alias("insufficient"),
        F.count_if(has("pairs", "tie")).alias("tied"))
    whole = F.col("unresolved") == 0
    share = lambda a, b: F.when(whole, F.col(a) / F.nullif(F.col(b), F.lit(0)))
    return out.select(
        "cases", "unresolved", share("clear", "cases").alias("clear_share"), F.when(whole, F.col("multi_applicable")).alias("multi_applicable"),
        share("multi_clear", "multi_applicable").alias("multi_clear_share"), share("decidable", "cases").alias("decidable_share"),
        share("insufficient", "cases").alias("insufficient_share"), share("tied", "cases").alias("tie_share"))


def breakdown(cases: DataFrame, resolved: DataFrame, subject: str, label: str, case: str = "case_id") -> DataFrame:
    """(subject, label, n, share) of the resolved cases of each subject."""
    counts = cases.select(case, subject).join(resolved.select(case, label), case).groupBy(subject, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(subject)))


def released(cases: DataFrame, case: str, secret: str) -> DataFrame:
    """Cases by an opaque id in its order, which says nothing of the order they came in."""
    return cases.withColumn("opaque_id", F.sha2(F.concat_ws("|", F.lit(secret), F.col(case).cast("string")), 256)).drop(case).orderBy("opaque_id")
