"""Panels of items that are frozen before they are judged: the union of groups, a digest of each item's conditions, the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import canonical
from tideline.operators import checks
from tideline.sources.records import require_none


def frozen_panel(groups: DataFrame, items: DataFrame, item: str, condition: str, form: canonical.Form = canonical.AUDIT) -> DataFrame:
    """(item, groups, condition_sha256) of each item of the union of groups (group, item). Each item is judged once per case, however
    many groups it is in. Items of a group that aren't known are an error."""
    panel = groups.groupBy(item).agg(F.array_sort(F.collect_set("group")).alias("groups"))  # an item's groups
    require_none(checks.unexpected(panel, items, [item]))
    digests = items.select(item, canonical.fingerprint(items, condition, form).alias("condition_sha256"))
    return panel.join(digests, item)


def panel_row(panel: DataFrame, cases: DataFrame, item: str, case: str) -> DataFrame:
    """One row of the release: items, cases, pairs, memberships per case, and a digest of the sorted items with their conditions. The
    digest is that of sums of hashes in 4,096 buckets, so no task sees all items."""
    each: Column = F.sha2(F.concat_ws("|", F.col(item).cast("string"), "condition_sha256"), 256)
    buckets = panel.select(F.substring(each, 1, 3).alias("b"), each.alias("h"), F.size("groups").alias("n"))
    buckets = buckets.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("items"), F.sum("n").alias("memberships"))
    whole = buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("panel_sha256"), F.sum("items").alias("items"), F.sum("memberships").alias("memberships_per_case"))
    counted = cases.agg(F.count_distinct(case).alias("cases"))
    return whole.join(counted).select("panel_sha256", "items", "cases", (F.col("items") * F.col("cases")).alias("pairs"), "memberships_per_case")


def exposure_plan(cases: DataFrame, exposed: DataFrame, subject: str, case: str, order: list[str]) -> DataFrame:
    """(subject, case, order) of the first case of each subject of whom no case was exposed: held out by subject, never by case. The
    first is the least by ``order``, then the case; nothing of a label enters the choice."""
    used = cases.join(exposed.select(case).distinct(), case, "left_semi").select(subject).distinct()
    free = cases.join(used, subject, "left_anti")
    first = free.groupBy(subject).agg(F.min(F.struct(*order, case)).alias("_f"))
    return first.select(subject, *[F.col(f"_f.{c}").alias(c) for c in (case, *order)])
