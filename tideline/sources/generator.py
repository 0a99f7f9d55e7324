"""Synthetic daily cases from 24 recipes, for any table of cases: a row per case and day, without any state.

Every number is a function of its key (counter-based): noise is the md5 of (seed, recipe, metric, day), so cases can be made in
any order, on any executor, one day at a time. A recipe changes some metrics on some days; the members of a matched pair share
noise, and one of them reads some metrics at other days (a permutation inside the window), so both have the same values as
bags. Intervals follow from the day's metrics: bouts of little movement are laid out one after the other, around the activity.

All metrics are minutes, counts, beats or milliseconds; times are minutes after the midnight of the day.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.sources.files import spread

START, DAYS, WINDOW = "2026-03-02", 42, 28

#: What a metric is on all days of all recipes, as middle and half width of its noise.
USUAL = {
    "sleep": (470, 8), "wake": (420, 0), "steps": (8000, 420), "activity": (55, 5), "low": (450, 12), "rhr": (56, 1), "hrv": (45, 2), "activity_start": (1260, 0),
}


@dataclass(frozen=True)
class Rule:
    """On the days from first to last, a metric of some recipes lies around the middles (taken in turn)."""

    metric: str
    recipes: tuple[int, ...]
    first: int
    last: int
    middles: tuple[int, ...]
    half: int = 0


#: The recipes. Later rules go before earlier ones.
RULES = (
    Rule("sleep", (1,), 0, 27, (465,), 10), Rule("sleep", (1,), 28, 41, (345,), 10),
    Rule("steps", (2,), 28, 41, (2500,), 450),
    Rule("sleep", (3, 5), 0, 34, (480,), 8), Rule("sleep", (3, 5), 35, 41, (360,), 8),
    Rule("hrv", (4,), 32, 35, (22, 25, 28, 24)),
    Rule("hrv", (6,), 34, 34, (23,)),
    Rule("sleep", (7,), 0, 27, (330,), 8), Rule("sleep", (7,), 28, 41, (450,), 8),
    Rule("steps", (8,), 0, 27, (9500,), 300), Rule("steps", (8,), 28, 41, (6500,), 250),
    Rule("rhr", (9,), 0, 27, (52,), 1), Rule("rhr", (11,), 0, 27, (62,), 1), Rule("rhr", (9, 11), 28, 41, (62,), 1),
    Rule("steps", (10,), 0, 27, (2800,), 240), Rule("steps", (10,), 28, 41, (8000,), 400),
    Rule("hrv", (12,), 0, 27, (26, 44, 54, 32, 48, 36, 40)), Rule("hrv", (12,), 28, 41, (30, 48, 38, 52, 34, 44, 40, 50, 32, 42, 28, 46, 36, 40)),
    Rule("sleep", (13,), 28, 41, (480,), 6), Rule("wake", (13,), 28, 41, (390, 540)),
    Rule("activity", (14,), 28, 41, (0, 5, 8, 4, 10, 2, 6, 5, 7, 0, 9, 3, 5, 4)), Rule("steps", (14,), 28, 41, (2200,), 300),
    Rule("sleep", (15,), 28, 41, (390, 390, 390, 390, 390, 570, 570), 5), Rule("wake", (15,), 28, 41, (420, 420, 420, 420, 420, 660, 660)),
    Rule("low", (16, 18), 28, 41, (480,)),
    Rule("sleep", (17,), 0, 41, (476,), 4), Rule("wake", (17,), 0, 41, (540,)),
    Rule("sleep", (19,), 28, 41, (330,), 8), Rule("steps", (19,), 28, 41, (2500,), 350),
    Rule("activity", (20,), 28, 41, (10,), 2), Rule("low", (20,), 28, 41, (600,), 8),
    Rule("sleep", (21, 23), 28, 41, (480, 390, 480, 390, 480, 390, 480, 480, 480, 390, 480, 390, 480, 390), 6),
    Rule("activity", (21, 23), 28, 41, (90, 45, 90, 45, 90, 45, 45, 45, 90, 45, 90, 45, 90, 45)),
    Rule("activity_start", (21, 23), 28, 41, (1230, 1050, 1230, 1050, 1230, 1050, 1050, 1050, 1230, 1050, 1230, 1050, 1230, 1050)),
    Rule("rhr", (22, 24), 32, 35, (65, 66, 67, 65)), Rule("hrv", (22, 24), 32, 35, (24, 26, 25, 23)),
)
#: The second of a matched pair and the first, whose noise it shares.
PAIRS = {5: 3, 11: 9, 18: 16, 23: 21, 24: 22}
#: Of the second of a pair, the days that a metric trades with others.
TRADES = {
    ("sleep", 5): tuple((28 + i, 35 + i) for i in range(7)), ("sleep", 23): ((29, 36), (31, 38), (33, 40)), ("hrv", 24): ((32, 36), (33, 37), (34, 38), (35, 39)),
}
#: The recipe and day with too little wear, and what isn't known then.
UNWORN, UNKNOWN = (8, 36), ("steps", "activity", "low")
#: Recipes whose bouts are long or broken in the window, with lengths and gaps; others have ten equal bouts.
LONG, BROKEN, GAP = ((16,), (150, 160, 170), 15), ((18,), (15,) * 32, 5), 5
STRATA = {"A": (1, 2, 7, 10, 13, 14, 19, 20), "B": (3, 4, 8, 9, 15, 16, 21, 22), "C": (5, 6, 11, 12, 17, 18, 23, 24)}
TYPES = ("single_variable", "personal_baseline", "temporal_pattern", "multivariable")


def noise(seed: Column, recipe: Column, metric: str, day: Column, half: int) -> Column:
    """A whole number from -half to half."""
    if not half:
        return F.lit(0).cast("long")
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), recipe.cast("string"), F.lit(metric), day.cast("string"))), 1, 8), 16, 10).cast("long") % (2 * half + 1) - half


def source_day(metric: str) -> Column:
    """The day whose value a metric has: another one where the recipe trades days."""
    out = F.col("n")
    for (traded, recipe), days in TRADES.items():
        if traded == metric:
            both = {**dict(days), **{b: a for a, b in days}}
            out = F.when(F.col("recipe") == recipe, F.coalesce(F.create_map(*[F.lit(x) for kv in both.items() for x in kv])[F.col("n")], F.col("n"))).otherwise(out)
    return out


def metric(name: str) -> Column:
    """A metric of the row's (seed, recipe, n)."""
    day, shared = source_day(name), F.coalesce(F.create_map(*[F.lit(x) for kv in PAIRS.items() for x in kv])[F.col("recipe")], F.col("recipe"))

    def around(middles: tuple[int, ...], half: int, first: int = 0) -> Column:
        middle = F.element_at(F.array(*[F.lit(m) for m in middles]), ((day - first) % len(middles) + 1).cast("int")) if len(middles) > 1 else F.lit(middles[0])
        return (middle + noise(F.col("seed"), shared, name, day, half)).cast("int")

    value = around(USUAL[name][:1], USUAL[name][1])
    for rule in RULES:
        if rule.metric == name:
            value = F.when(F.col("recipe").isin(*rule.recipes) & day.between(rule.first, rule.last), around(rule.middles, rule.half, rule.first)).otherwise(value)
    return value


def _interval(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def bouts(rows: DataFrame, n: Column, length: Callable[[Column], Column], before: Callable[[Column], Column], start: Column, busy_from: Column, busy_to: Column, name: str) -> DataFrame:
    """The rows with ``n`` intervals, the k-th of ``length(k)`` minutes and ``before(k)`` minutes after the start, up to the first that would run
    into the busy time: it starts five minutes after that time, and those that follow as much later as it does. What all intervals of a
    row share is a column, so that it is computed once a row."""
    at = lambda k: F.col("_from") + before(k)
    rows = rows.withColumn("_from", start).withColumn("_places", F.sequence(F.lit(0), (n - 1).cast("int")))
    hits = F.filter("_places", lambda k: (at(k) < busy_to) & (at(k) + length(k) > busy_from))
    rows = rows.withColumn("_first", F.when(busy_to > busy_from, F.get(hits, F.lit(0))))
    rows = rows.withColumn("_late", busy_to + 5 - at(F.col("_first")))

    def laid(k: Column) -> Column:
        first = at(k) + F.when(k >= F.col("_first"), F.col("_late")).otherwise(0)
        return _interval(first, first + length(k))

    return rows.withColumn(name, F.transform("_places", laid)).drop("_from", "_places", "_first", "_late")


def generated_cases(cases: DataFrame, start: str = START, facts: tuple[str, ...] = ()) -> DataFrame:
    """Days of the cases (case, recipe from 1 to 24, seed): case, recipe, n (from 0), day, phase, wear and coverage, the metrics, those that are
    missing, activity and low-movement intervals (minutes of the day; they may end after midnight), and the ``facts``, columns of the
    case. Cases are dealt out over all cores first, since each becomes many days."""
    days = spread(cases.select("case", "recipe", "seed", *facts)).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))))
    rows = days.select("case", "recipe", "n", *facts, F.expr(f"date_add(DATE'{start}', n)").alias("day"), F.when(F.col("n") < WINDOW, "baseline").otherwise("window").alias("phase"), *[metric(m).alias(m) for m in USUAL])
    inside = F.col("n") >= WINDOW
    long, broken = (inside & F.col("recipe").isin(*style[0]) for style in (LONG, BROKEN))
    opportunity = F.when(F.col("recipe") == 17, 480).otherwise(F.col("sleep") + 20)
    # of the bouts of a style: how many, the length of the k-th, and the minutes before it
    styles = {name: (lambda k, x=lengths: F.element_at(F.array(*[F.lit(v) for v in x]), k + 1), lambda k, x=lengths, gap=gap: F.element_at(F.array(*[F.lit(sum(x[:i]) + i * gap) for i in range(len(x))]), k + 1)) for name, (_, lengths, gap) in (("long", LONG), ("broken", BROKEN))}
    tenth, rest = F.floor(F.col("low") / 10).cast("int"), F.col("low") % 10
    length = lambda k: F.when(long, styles["long"][0](k)).when(broken, styles["broken"][0](k)).otherwise(tenth + F.when(k < rest, 1).otherwise(0))
    before = lambda k: F.when(long, styles["long"][1](k)).when(broken, styles["broken"][1](k)).otherwise(k * (tenth + GAP) + F.least(k, rest))
    count = F.when(long, len(LONG[1])).when(broken, len(BROKEN[1])).otherwise(10)
    begun, ended = F.col("activity_start"), F.col("activity_start") + F.col("activity")
    rows = bouts(rows, count, length, before, F.greatest(F.lit(600), F.col("wake") + 30), begun, ended, "low_intervals")
    # a gap alone is no movement: each break between broken bouts holds an active minute
    minutes = F.transform(F.slice("low_intervals", F.lit(1), F.size("low_intervals") - 1), lambda i: _interval(i["end"] + 1, i["end"] + 2))
    left = F.col("activity") - F.size(minutes)
    none = F.array().cast("array<struct<start: int, end: int>>")
    once = lambda n: F.when(n > 0, F.array(_interval(begun, begun + n))).otherwise(none)
    active = F.when(broken, F.concat(minutes, once(left))).otherwise(once(F.col("activity")))
    unworn = (F.col("recipe") == UNWORN[0]) & (F.col("n") == UNWORN[1])
    known = {m: F.when(unworn, None).otherwise(F.col(m)).alias(m) if m in UNKNOWN else F.col(m) for m in ("sleep", "wake", "steps", "activity", "low", "rhr", "hrv")}
    return rows.select(
        "case", "recipe", "n", *facts, "day", "phase", F.when(unworn, 360).otherwise(720).alias("wear"), opportunity.cast("int").alias("coverage"), (F.col("wake") - opportunity).cast("int").alias("sleep_start"), *known.values(),
        F.when(unworn, F.array(*[F.lit(m) for m in UNKNOWN])).otherwise(F.array().cast("array<string>")).alias("missing"),
        F.when(unworn, none).otherwise(active).alias("activity_intervals"), F.when(unworn, none).otherwise(F.col("low_intervals")).alias("low_intervals"),
    )


def case_facts(cases: DataFrame) -> DataFrame:
    """(case, recipe, case_type, stratum, pair): the recipe's kind, stratum, and the lower recipe of its matched pair, if it is in one."""
    stratum = F.coalesce(*[F.when(F.col("recipe").isin(*r), s) for s, r in STRATA.items()])
    pair = {**PAIRS, **{a: a for a in PAIRS.values()}}
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.expr("cast((recipe - 1) div 6 + 1 as int)"))
    return cases.select("case", "recipe", kind.alias("case_type"), stratum.alias("stratum"), F.create_map(*[F.lit(x) for kv in pair.items() for x in kv])[F.col("recipe")].alias("pair"))
