"""The best snapshot known at a time, stored results under newer rules, and records put together from many tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators import records


def best_before(requests: DataFrame, snapshots: DataFrame, key: str, at: str, kind: str, kinds: list[str], keep: list[str], width: int) -> DataFrame:
    """The requests (key, at and more) with ``kind`` and ``keep`` of a snapshot (key, at, kind, keep) of their key that isn't later: the latest
    of the first of ``kinds`` that has any; nulls if none has. Of snapshots at one time the greatest in ``keep`` counts.

    Rows are ordered within buckets of ``width`` of a key, after the last snapshots of the buckets before, so a key with many rows
    is spread over tasks."""
    own = F.struct(F.col(at).alias("at"), *[F.col(c) for c in keep])
    last = lambda name: F.when(F.col(kind) == name, own)
    bucket = F.floor(F.col(at) / width).cast("long").alias("_b")
    there = snapshots.select(key, bucket, F.col(at).alias("_at"), F.lit(0).alias("_asked"), *[last(n).alias(f"_k{i}") for i, n in enumerate(kinds)])
    totals = there.groupBy(key, "_b").agg(*[F.max(f"_k{i}").alias(f"_c{i}") for i in range(len(kinds))])
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    asked = requests.select(key, bucket, F.col(at).alias("_at"), F.lit(1).alias("_asked"), F.struct(*requests.columns).alias("_row"))
    # buckets without snapshots have a row too, as requests may lie there
    every = totals.unionByName(asked.select(key, "_b").distinct().join(totals, [key, "_b"], "left_anti"), allowMissingColumns=True)
    carried = every.select(key, "_b", *[F.last(f"_c{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(kinds))])
    inside = W.partitionBy(key, "_b").orderBy("_at", "_asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = there.unionByName(asked, allowMissingColumns=True)
    rows = rows.select(key, "_b", "_asked", "_row", *[F.max(f"_k{i}").over(inside).alias(f"_k{i}") for i in range(len(kinds))]).where("_asked = 1")
    rows = rows.join(carried, [key, "_b"], "left")
    best = F.coalesce(*[F.when(F.coalesce(f"_k{i}", f"_c{i}").isNotNull(), F.struct(F.lit(n).alias("kind"), F.coalesce(f"_k{i}", f"_c{i}").alias("s"))) for i, n in enumerate(kinds)])
    return rows.select("_row.*", best.alias("_best")).select(*requests.columns, F.col("_best.kind").alias(kind), *[F.col(f"_best.s.{c}").alias(c) for c in keep])


def packets(parts: DataFrame, keys: list[str], place: str, text: str, terms: Column, budget: int) -> DataFrame:
    """(keys, used, kept places) of the parts (keys, place, text) that share most words with ``terms`` (an array), as many as the budget
    of bytes takes: by falling overlap, then place; what doesn't fit is passed over."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))
    scored = parts.withColumn("_score", F.size(F.array_intersect(words, terms)))
    return records.packed(scored, keys, [-F.col("_score"), F.col(place)], F.octet_length(text), place, budget)


def revalidated(stored: DataFrame, version: int, rules: dict[str, Column], errors: str = "errors", usable: str = "usable", by: str = "validator_version") -> DataFrame:
    """Stored results with the columns of an older validator replaced: the names of the rules that don't hold (unknown counts as
    broken), whether there are none, and the version. Results of this or a newer version and all other columns stay, so doing it
    twice is doing it once."""
    old = F.coalesce(F.col(by) < version, F.lit(True))
    found = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(n)) for n, holds in rules.items()]))
    new = {errors: F.when(old, found).otherwise(F.col(errors)), usable: F.when(old, F.size(found) == 0).otherwise(F.col(usable)), by: F.when(old, version).otherwise(F.col(by)).cast(stored.schema[by].dataType)}
    return stored.select(*[new[c].alias(c) if c in new else F.col(c) for c in stored.columns])


def assembled(parts: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """One nested record per key: an array of structs for each part (table with the key, and the columns that order its rows). All parts
    go through one shuffle by key, as a union, instead of a chain of joins. A key's rows are one task's; parts are a case's own."""
    rows = []
    for name, (df, order) in parts.items():
        rest = [c for c in df.columns if c != key and c not in order]
        rows.append(df.select(key, F.struct(*order, *rest).alias(name)))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return whole.groupBy(key).agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in parts])


def failures(records_: DataFrame, key: str, miss: str, gain: str, visible: float = 0.05) -> DataFrame:
    """The records with their place among the failures (largest miss first, unknown ones last as 0, then by key), and whether the
    gain is one that is seen in practice. Places are counted over ranges of the order, so no task sees all records."""
    from tideline.operators import runs

    scored = records_.select(key, F.lit(0).alias("_all"), F.coalesce(miss, F.lit(0.0)).alias("score"))
    placed = runs.ranked_whole(scored, "_all", key).select(key, F.col("rank").alias("place"))
    return records_.join(placed, key).withColumn("visible_gain", F.coalesce(F.col(gain) >= visible, F.lit(False)))
