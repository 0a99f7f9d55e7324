"""Integrity checks: each returns one row per violation (rule, key, detail); an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _out(df: DataFrame, rule: str, keys: list[str], detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]).alias("key"), detail.cast("string").alias("detail"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return _out(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "duplicate", keys, F.col("n"))


def missing(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return _out(expected.select(*keys).distinct().join(df, keys, "left_anti"), "missing", keys, F.lit("absent"))


def unexpected(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return _out(df.select(*keys).distinct().join(expected, keys, "left_anti"), "unexpected", keys, F.lit("not expected"))


def holds(df: DataFrame, rule: str, keys: list[str], condition: Column, detail: Column) -> DataFrame:
    """Rows for which the condition isn't true; unknown counts as a violation."""
    return _out(df.where(~F.coalesce(condition, F.lit(False))), rule, keys, detail)


def all_hold(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """As ``holds`` for several rules, in one pass over the rows; the detail is the rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    rows = df.select(*keys, F.explode(broken).alias("_rule"))
    return _out(rows, "", keys, F.col("_rule")).withColumn("rule", F.col("detail"))


def ranks(ranking: DataFrame, run: list[str], item: str, k: int) -> DataFrame:
    """Runs need the ranks 1 to k, distinct items, finite scores, and ties in order of items."""
    w = W.partitionBy(*run).orderBy("rank")
    rows = ranking.withColumn("want", F.row_number().over(w)).withColumn("last", F.lag("score").over(w)).withColumn("last_item", F.lag(item).over(w))
    size = ranking.groupBy(*run).agg(F.count("*").alias("n")).where(F.col("n") != k)
    return reduce(DataFrame.unionByName, [
        _out(size, "size", run, F.col("n")), holds(rows, "consecutive", [*run, item], F.col("rank") == F.col("want"), F.col("rank")),
        holds(rows, "finite", [*run, item], ~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score")),
        holds(rows, "order", [*run, item], F.col("last").isNull() | (F.col("last") > F.col("score")) | ((F.col("last") == F.col("score")) & (F.col("last_item") < F.col(item))), F.col("rank")),
        duplicates(ranking, [*run, item]),
    ])


def same_values(left: DataFrame, right: DataFrame, keys: list[str], value: str, absolute: float = 1e-10, relative: float = 0.0) -> DataFrame:
    """Keys on one side only, and values further apart than allowed; two nulls are equal."""
    both = left.select(*keys, F.col(value).alias("x"), F.lit(1).alias("l")).join(right.select(*keys, F.col(value).alias("y"), F.lit(1).alias("r")), keys, "full_outer")
    near = F.abs(F.col("x") - F.col("y")) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs("x"), F.abs("y")))
    return holds(both, "value", keys, F.col("l").isNotNull() & F.col("r").isNotNull() & (near | (F.col("x").isNull() & F.col("y").isNull())), F.concat_ws(" <> ", F.coalesce(F.col("x").cast("string"), F.lit("null")), F.coalesce(F.col("y").cast("string"), F.lit("null"))))


def changed(left: DataFrame, right: DataFrame, name: str, digest: str) -> DataFrame:
    """Names whose digest differs between two manifests, or that one lacks."""
    both = left.select(name, F.col(digest).alias("x")).join(right.select(name, F.col(digest).alias("y")), name, "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select(name, F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))
