"""A corpus of items from seeds and fetched sources: built only where the sources bear it out, and checked again later.

A seed names its source, and anchors: passages that the source's text must hold (white space and case don't count). Items get ids
in the order of the seeds. What isn't borne out is a violation and no item: sources that weren't fetched, anchors that
aren't found or aren't named at all, titles and contents that are there twice, domains whose number of items isn't the expected one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import canonical
from tideline.functions.text import normalized
from tideline.operators import cases, checks, runs
from tideline.sources.records import Rejected, require_none
from tideline.sources.shared import settled

FETCHED = "fetched"
#: Fixed values of retrieval settings: those that may not differ, and those that are filled in.
FROZEN = {"indexed_fields": ["title", "content"], "top_k": 20, "rrf_k": 60}
DEFAULTS = {"query_max_tokens": 512, "bm25": {"k1": 1.5, "b": 0.75}}


def settings(given: dict) -> dict:
    """Retrieval settings with what is missing filled in; frozen ones that differ, and parameters out of range, are rejected."""
    out = DEFAULTS | FROZEN | given
    for name, value in FROZEN.items():
        if out[name] != value:
            raise Rejected(f"{name} is frozen at {value}")
    if not (0 <= out["bm25"]["b"] <= 1 and out["bm25"]["k1"] > 0):
        raise Rejected("k1 must be positive and b lie between 0 and 1")
    return out | {"tie_breaking": "id ascending", "fusion": "reciprocal ranks of five rankings"}


def _borne_out(seeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Seeds (order, source_key, title, content, domain, anchors) with their source, and the anchors that its text lacks. Each source's
    text goes to its own seeds once, as one row of all their anchors."""
    seeds = seeds.withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
    asked = seeds.groupBy("source_key").agg(F.collect_set(F.struct("anchors")).alias("_sets"))
    anchors = F.array_distinct(F.flatten(F.transform("_sets", lambda s: s["anchors"])))
    text = normalized(F.coalesce("text", F.lit("")))
    found = sources.join(asked, "source_key").select("source_key", F.filter(anchors, lambda a: F.contains(text, normalized(a))).alias("_there"))
    facts = sources.drop("text").join(found, "source_key", "left")
    both = seeds.join(facts, "source_key", "left")
    return both.withColumn("missing", F.array_except(F.col("anchors"), F.coalesce("_there", F.array().cast("array<string>")))).drop("_there")


def violations(seeds: DataFrame, sources: DataFrame, quotas: DataFrame, order: str = "place") -> DataFrame:
    """Rows (rule, key, detail) of what a build may not have; quotas: (domain, n)."""
    both = settled(_borne_out(seeds, sources), "seeds")
    twice = both.groupBy(F.sha2(normalized(F.concat("title", "content")), 256).alias("words")).agg(F.min(order).alias(order), F.count("*").alias("n"))
    holds = lambda df, rule, condition, detail: checks.holds(df, rule, [order], condition, detail)
    return reduce(DataFrame.unionByName, [
        holds(both, "source", F.col("status") == FETCHED, F.col("source_key")), holds(both, "anchor", ((F.size("missing") == 0) & (F.size("anchors") > 0)) | ~F.col("status").eqNullSafe(F.lit(FETCHED)), F.array_join("missing", " | ")),
        holds(twice, "duplicate", F.col("n") == 1, F.col("n")), cases.quota_violations(both, quotas, ["domain"]),
    ])


def items(seeds: DataFrame, sources: DataFrame, order: str = "place", pattern: str = "K%03d") -> DataFrame:
    """(id, domain, title, content, source, source_url, source_locator, status) of the seeds that are borne out, numbered in the
    order of the seeds; the digest of each as a record is ``item_sha256``."""
    both = _borne_out(seeds, sources).where((F.col("status") == FETCHED) & (F.size("missing") == 0) & (F.size("anchors") > 0))
    placed = runs.ranked_whole(seeds.select(F.lit(0).alias("_all"), F.col(order), F.lit(0.0).alias("score")), "_all", order).select(order, F.format_string(pattern, "rank").alias("id"))
    out = both.join(placed, order).select("id", "domain", "title", "content", F.col("publisher").alias("source"), "source_url", F.concat(F.lit("text anchors: "), F.array_join("anchors", " | ")).alias("source_locator"), F.lit("verified").alias("status"))
    record = out.withColumn("_record", F.struct(*out.columns))
    return record.withColumn("item_sha256", canonical.fingerprint(record, "_record")).drop("_record")


def review_contexts(seeds: DataFrame, sources: DataFrame, order: str = "place", before: int = 700, after: int = 1900) -> DataFrame:
    """(order, anchor, context): what a reviewer sees of the source around each anchor that it has."""
    text = F.regexp_replace("text", r"\s+", " ")
    each = seeds.select(order, "source_key", F.explode("anchors").alias("anchor")).join(sources.where(F.col("status") == FETCHED).select("source_key", text.alias("text")), "source_key")
    at = F.call_function("locate", F.col("anchor"), F.col("text"))
    first = F.greatest(F.lit(1), at - before)
    shown = F.when(at > 0, F.substring("text", first, at - first + after))  # null where only case or white space differ
    return each.where(F.contains(normalized("text"), normalized("anchor"))).select(order, "anchor", shown.alias("context"))


def corpus_digest(corpus: DataFrame, column: str = "item_sha256") -> str:
    """A digest of all items, whatever their order: that of the sums of their digests' parts."""
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(column, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return corpus.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[part(k) for k in range(8)]), 256)).first()[0]


def same_corpus(corpus: DataFrame, manifest: DataFrame, column: str = "corpus_sha256") -> None:
    """Rejects a corpus other than the one that a run's manifest names."""
    now = corpus_digest(corpus)
    require_none(checks.holds(manifest, "corpus", [column], F.col(column) == now, F.lit(now)))


def claim_view(audits: DataFrame, knowledge: DataFrame, key: str, fields: list[str], condition: Column, condition_fields: list[str]) -> DataFrame:
    """What a judge may see of an item: its allowed fields, and of its audit the claim's support, whether its scope is disputed and the
    conditions with their allowed fields; nothing else of either."""
    shown = F.transform(condition, lambda c: F.struct(*[c[f].alias(f) for f in condition_fields]))
    own = audits.select(key, "core_claim_support", "source_scope_disputed", shown.alias("conditions"), F.coalesce("validation_errors", F.array().cast("array<string>")).alias("validation_errors"))
    return knowledge.select(key, *fields).join(own, key)
