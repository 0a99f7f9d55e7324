"""Imports of device exports, labels and reviewers' files; stored results; generated series; stages in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import checks

#: Upper bounds of imported values (fixed values).
MOST_MINUTES, MOST_RATE, MOST_CODE = 1440, 300, 100


class Rejected(ValueError):
    """Input that breaks a rule; the message has the first few violations."""


def require_none(violations: DataFrame) -> None:
    found = violations.limit(5).collect()
    if found:
        raise Rejected("; ".join(f"{r['rule']} {r['key']}: {r['detail']}" for r in found))


def within(c: Column, most: float) -> Column:
    """Null, or a finite number from 0 to most."""
    return c.isNull() | (~F.isnan(c.cast("double")) & c.between(0, most))


def daily_metric(raw: DataFrame, most: float = MOST_MINUTES) -> DataFrame:
    """(day, value) of records (dateTime, value: number as text, or an object {value} as text); days are unique, values bounded."""
    inner = F.try_variant_get(F.try_parse_json(F.col("value")), "$.value", "double")
    rows = raw.select(F.to_date(F.substring("dateTime", 1, 10)).alias("day"), F.coalesce(inner, F.col("value").try_cast("double")).alias("value"))
    require_none(checks.duplicates(rows, ["day"]).unionByName(checks.holds(rows, "bounds", ["day"], within(F.col("value"), most), F.col("value"))))
    return rows


def collapsed(df: DataFrame, keys: list[str], fields: list[str], identity: list[str] = ()) -> DataFrame:
    """One row per key: equal observations are one (flag repeated), different ones are withheld (null fields, flag conflict)."""
    digest = F.sha2(F.to_json(F.struct(*identity, *fields), {"ignoreNullFields": "false"}), 256)
    rows = df.groupBy(*keys).agg(F.count_distinct(digest).alias("_k"), F.count("*").alias("_n"), F.first(F.struct(*fields)).alias("_f"))
    return rows.select(*keys, *[F.when(F.col("_k") == 1, F.col(f"_f.{f}")).alias(f) for f in fields], F.when(F.col("_k") > 1, "conflict").when(F.col("_n") > 1, "repeated").alias("flag"))


def main_sleep(logs: DataFrame) -> DataFrame:
    """One row per day of waking from logs (logId, dateOfSleep, startTime, endTime, mainSleep, minutesAsleep, timeInBed, type,
    infoCode): only explicit main sleeps; equal logs are one, different ones withheld."""
    rows = logs.where(F.col("mainSleep").eqNullSafe(F.lit(True)))
    start, end = F.col("startTime").cast("timestamp_ntz"), F.col("endTime").cast("timestamp_ntz")
    day = F.coalesce(F.to_date("dateOfSleep"), F.to_date(end))
    rows = rows.select(
        "logId", day.alias("day"), F.col("minutesAsleep").cast("double").alias("sleep_minutes"), F.col("timeInBed").cast("double").alias("time_in_bed_minutes"), F.date_format(start, "HH:mm:ss").alias("start_clock"),
        F.date_format(end, "HH:mm:ss").alias("end_clock"), F.datediff(F.to_date(start), day).alias("start_day_offset"), F.col("type").alias("log_type"), F.col("infoCode").cast("double").alias("info_code"),
    )
    good = within(F.col("sleep_minutes"), MOST_MINUTES) & within(F.col("time_in_bed_minutes"), MOST_MINUTES) & within(F.col("info_code"), MOST_CODE) & (F.col("log_type").isNull() | F.col("log_type").isin("classic", "stages"))
    require_none(checks.holds(rows, "sleep", ["logId"], good, F.col("log_type")))
    return collapsed(rows, ["day"], [c for c in rows.columns if c not in ("logId", "day")], ["logId"])


def merged(metrics: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of (keys, value) tables: one pass over their union, a column per metric."""
    long = None
    for n, d in metrics.items():
        part = d.select(*keys, F.lit(n).alias("_m"), F.col("value").cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == n, F.col("value"))).alias(n) for n in metrics])


def gold(labels: DataFrame, expected: DataFrame, keys: list[str], label: str, kind: str, levels: tuple[int, ...] = (0, 1, 2), kind_column: str = "label_kind") -> DataFrame:
    """Labels of the full matrix of expected keys; anything else is rejected."""
    require_none(
        checks.missing(labels, expected, keys).unionByName(checks.unexpected(labels, expected, keys)).unionByName(checks.duplicates(labels, keys))
        .unionByName(checks.holds(labels, "label", keys, F.col(label).isin(*levels), F.col(label))).unionByName(checks.holds(labels, "kind", keys, F.col(kind_column) == kind, F.col(kind_column)))
    )
    return labels.select(*keys, F.col(label).cast("int").alias("relevance"))


def reviewer_exports(df: DataFrame, reviewer: str = "reviewer_id", card: str = "case_ref") -> DataFrame:
    """One reviewer's cards, each once; no cards, several reviewers or repeated cards are rejected."""
    n, who = df.agg(F.count("*"), F.count_distinct(reviewer)).first()
    if n == 0 or who != 1:
        raise Rejected(f"{n} cards of {who} reviewers")
    require_none(checks.duplicates(df, [card]))
    return df


def inventory(spark: SparkSession, folder: str, expected: DataFrame, name: str = "name") -> DataFrame:
    """Violations of a folder against expected file names without endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias(name))
    return checks.missing(files, expected, [name]).unionByName(checks.unexpected(files, expected, [name])).unionByName(checks.duplicates(files, [name]))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path; made and written first if its success mark is missing, so half-written results are made anew."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def vector_cache(spark: SparkSession, root: str, items: DataFrame, settings: str, make: Callable[[], DataFrame], key: str = "id", text: str = "text", vector: str = "embedding") -> DataFrame:
    """Vectors stored under a digest of settings, ids and texts; after loading, all must be finite and of unit length."""
    parts = items.select(F.xxhash64(key, text).cast("decimal(38,0)").alias("h"), F.crc32(F.concat_ws("|", key, text)).alias("c"))
    total = parts.agg(F.sum("h"), F.sum("c"), F.count("*")).first()
    import hashlib

    folder = hashlib.sha256(f"{settings}|{total[0]}|{total[1]}|{total[2]}".encode()).hexdigest()
    out = stored(spark, f"{root.rstrip('/')}/{folder}", make)
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    require_none(checks.holds(out, "unit vector", [key], F.abs(norm - 1) <= 1e-3, norm))
    return out


def calibration_series(spark: SparkSession, start: str, days: int = 14) -> DataFrame:
    """(series, day, sleep_minutes, start_clock_minutes, steps): short sleep, varying bedtimes, missing steps."""
    at = spark.range(days).withColumn("day", F.expr(f"date_add(DATE'{start}', cast(id as int))"))
    late = F.when(F.col("id") % 2 == 0, 0).otherwise(120)
    row = lambda n, sleep, clock, steps: at.select(F.lit(n).alias("series"), "day", F.lit(sleep).cast("double").alias("sleep_minutes"), clock.cast("double").alias("start_clock_minutes"), steps.cast("long").alias("steps"))
    return row("short_sleep", 330, F.lit(1410), F.lit(7000)).unionByName(row("varying_timing", 450, 1320 + late, F.lit(7000))).unionByName(row("missing_steps", 450, F.lit(1380), F.when(F.col("id") % 3 != 0, 7000)))


def generated_days(spark: SparkSession, cases: int, days: int, seed: str, start: str = "2026-01-01") -> DataFrame:
    """(case, day, steps, sleep_minutes): reproducible noise from md5(seed, case, day, metric) around weekly shapes. Cases 2k
    and 2k + 1 share their noise; the second has its weeks in reverse order."""
    grid = spark.range(cases * days).select((F.col("id") / days).cast("long").alias("case"), (F.col("id") % days).cast("int").alias("n"))
    source = F.when(F.col("case") % 2 == 0, F.col("n")).otherwise(days - 1 - F.col("n"))
    noise = lambda m: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.expr("case div 2"), source, F.lit(m))), 1, 8), 16, 10).cast("double") / 2**32
    return grid.select("case", F.expr(f"date_add(DATE'{start}', n)").alias("day"), F.floor(6000 + 4000 * noise("steps")).alias("steps"), F.round(400 + 80 * noise("sleep"), 1).alias("sleep_minutes"))


def run_stages(stages: list[tuple[str, Callable]], first: str, last: str) -> dict[str, object]:
    """Runs the stages from first to last in their order."""
    names = [n for n, _ in stages]
    a, b = names.index(first), names.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return {n: f() for n, f in stages[a : b + 1]}
