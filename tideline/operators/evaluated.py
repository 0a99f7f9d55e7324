"""The evaluation of saved rankings as one release: every table or none, and only for the corpus that the run names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import checks, evaluation
from tideline.operators.evaluation import ratio
from tideline.sources import corpus as corpora
from tideline.sources import release
from tideline.sources.records import require_none
from tideline.sources.shared import settled

METRICS = ["recall5", "recall10", "recall20", "strong_recall10", "ndcg10", "irrelevant10"]


def group_metrics(rankings: DataFrame, gold: DataFrame, items: DataFrame, run: list[str], case: str, item: str, group: str) -> DataFrame:
    """Per run and group of items: recall and strong recall within the group in the top 10, the group's share of it, and the share of
    irrelevant ones among those returned; nulls where nothing is to be divided by. Groups that a case has neither positives nor
    results of have no row."""
    top = rankings.where(F.col("rank") <= 10).join(items.select(item, group), item).join(gold.select(case, item, "relevance"), [case, item], "left")
    shown = rankings.where(F.col("rank") <= 10).groupBy(*run).agg(F.count("*").alias("shown"))
    found = top.groupBy(*run, group).agg(F.count("*").alias("returned"), F.count_if(F.col("relevance") >= 1).alias("hits"), F.count_if(F.col("relevance") >= 2).alias("strong_hits"))
    wanted = gold.join(items.select(item, group), item).groupBy(case, group).agg(F.count_if(F.col("relevance") >= 1).alias("positives"), F.count_if(F.col("relevance") >= 2).alias("strong"))
    pairs = rankings.select(*run).distinct().join(wanted, case).select(*run, group).union(found.select(*run, group)).distinct()
    both = pairs.join(found, [*run, group], "left").join(wanted, [case, group], "left").join(shown, run).na.fill(0, ["returned", "hits", "strong_hits", "positives", "strong"])
    return both.select(
        *run, group, ratio(F.col("hits"), F.col("positives")).alias("recall10"), ratio(F.col("strong_hits"), F.col("strong")).alias("strong_recall10"),
        ratio(F.col("returned"), F.col("shown")).alias("share10"), ratio(F.col("returned") - F.col("hits"), F.col("returned")).alias("irrelevant10"),
    )


def evaluate(spark: SparkSession, folder: str, rankings: DataFrame, gold: DataFrame, items: DataFrame, manifest: DataFrame, case: str, item: str, group: str, cluster: Column, draws: int = 10_000, seed: str = "1729") -> DataFrame:
    """Publishes the evaluation of rankings (method, repeat, case, item, rank) against gold (case, item, relevance) and returns the
    release's manifest. Tables: per_run, per_case, summary, paired_comparisons, cluster_bootstrap, group_per_case, group_breakdown and
    facts. Items have a digest ``item_sha256``; a corpus other than that of the run's manifest is rejected, and so are repeated
    labels, items or ranks. Repeats count as means within a case, cases count alike."""
    corpora.same_corpus(items, manifest)
    run = ["method", "repeat", case]
    rankings, gold = settled(rankings.select(*run, item, "rank"), "rankings"), settled(gold.select(case, item, "relevance"), "gold")
    require_none(checks.duplicates(items, [item]).unionByName(checks.duplicates(gold, [case, item])).unionByName(checks.duplicates(rankings, [*run, "rank"])))
    per_run = settled(evaluation.ranking_metrics(rankings, gold, run, case, item).select(*run, *METRICS), "per_run")
    per_case = settled(per_run.groupBy("method", case).agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("repeats")), "per_case")
    summary = per_case.groupBy("method").agg(*[a for m in METRICS for a in (F.avg(m).alias(m), F.count(m).alias(f"{m}_valid"))], F.count("*").alias("cases"))
    differences = settled(evaluation.pairwise_differences(per_case, "method", [case], "ndcg10").withColumn("cluster", cluster), "differences")
    pairs = [tuple(r) for r in differences.select("a", "b").distinct().collect()]  # pairs of methods
    intervals = None
    for a, b in pairs:
        one = evaluation.cluster_bootstrap(differences.where((F.col("a") == a) & (F.col("b") == b)), "cluster", "diff", draws, seed).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "mean", "low", "high", "draws")
        intervals = one if intervals is None else intervals.unionByName(one)
    per_group = settled(group_metrics(rankings, gold, items, run, case, item, group), "groups")
    names = ["recall10", "strong_recall10", "share10", "irrelevant10"]
    group_case = per_group.groupBy("method", case, group).agg(*[F.avg(m).alias(m) for m in names])
    breakdown = group_case.groupBy("method", group).agg(*[a for m in names for a in (F.avg(m).alias(m), F.count(m).alias(f"{m}_valid"))], F.count("*").alias("cases"))
    labelled = gold.groupBy(case).agg(F.max("relevance").alias("most"), F.count("*").alias("n"))
    facts = labelled.agg(F.count("*").alias("cases"), F.sum("n").alias("labels"), F.count_if(F.col("most") == 0).alias("all_zero_cases"), F.count_if(F.col("most") < 2).alias("no_strong_cases"))
    tables = {"per_run": per_run, "per_case": per_case, "summary": summary, "paired_comparisons": differences, "group_per_case": group_case, "group_breakdown": breakdown, "facts": facts}
    if intervals is not None:
        tables["cluster_bootstrap"] = intervals
    return release.publish(spark, folder, tables, {"gain": "2^relevance - 1", "discount": "log2(rank + 1)", "bootstrap": {"draws": draws, "seed": seed}})
