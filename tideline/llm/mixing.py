"""Mixing sources to target weights by hierarchical budgeting [native: DataFrame functions only].

Leaves of a tree domain - language - source have token capacities (tokens times EPOCHS) and weights. A budget of tokens
goes down the tree: at each node it is filled into the children in proportion to their weights, and a child whose
subtree can't take its part gets its capacity, the rest going to its siblings; only what all siblings together can't take
is left to the parent's siblings, since a parent never gets more than its subtree's capacity. The filling is
exact: children by rising capacity per weight, running sums of capacities and weights, whole tokens (decimals).

A leaf's target is met from seeded epochs: target div tokens whole epochs, then from the next epoch, in the order of
md5(seed, epoch, id), the documents whose middle token lies before what is left of the target. Running sums in a leaf
are taken per bucket of that hash, after the buckets' totals; the buckets of a leaf, BUCKETS at least, grow with the
largest leaf, and hot leaves meet their targets in parts, so a hot leaf is spread over all tasks.

A document is all rows of one id in one leaf. Tokens are words ([^\\x20\\x09-\\x0D]+); a document without words takes no
tokens and comes with its place in the order. Nulls: null languages, sources and ids are values of their own; a null text
has no words. Leaves without weights get DEFAULT_WEIGHT; a leaf with a weight of 0 or less gets nothing, and its tokens count
neither as capacity nor in the budget. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.frames import Settled, Spread, buckets_for, hashed, unclashing

SEED, EPOCHS, BUCKETS, DEFAULT_WEIGHT = "mix-1", 2, (256, 1 << 16), 1
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source where no taxonomy is given: four domains by the md5 of its name."""
    return F.concat(F.lit("domain"), (hashed(source) % 4).cast("string"))


def allocate(leaves: DataFrame, budget: int | Column) -> DataFrame:
    """leaves (domain, lang, source, capacity, weight) with the leaf's target; weights are longs and add up on each level."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    nodes = {3: leaves}
    for depth in (2, 1):
        nodes[depth] = nodes[depth + 1].groupBy(*LEVELS[:depth]).agg(F.sum("capacity").alias("capacity"), F.sum("weight").alias("weight"))
    total = nodes[1].agg(F.sum("capacity").alias("c"))
    given = total.select(F.least(F.coalesce(F.col("c"), F.lit(0)), budget if isinstance(budget, Column) else F.lit(budget)).cast("long").alias("budget"))
    filled = given.withColumn("root", F.lit(0))
    for depth in (1, 2, 3):
        above = ["root", *LEVELS[: depth - 1]]
        children = nodes[depth].withColumn("root", F.lit(0))
        filled = filled.select("budget", *[F.col(c).alias(f"up_{c}") for c in above])
        match = F.lit(True)
        for c in above:
            match = match & (F.col(c) == F.col(f"up_{c}"))
        each = children.join(filled, match).drop(*[f"up_{c}" for c in above])
        order = W.partitionBy(*above).orderBy((big("capacity") * F.lit(1000000).cast("decimal(10,0)") / F.nullif(big("weight"), F.lit(0))).cast("decimal(38,6)"), *LEVELS[:depth])
        before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
        each = each.withColumn("filled", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(rest))
        # full: it can't take its part of what is left after the smaller ones
        full = big("capacity") * big("open") <= (big("budget") - big("filled")) * big("weight")
        each = each.withColumn("full", full)
        # the first that isn't full fixes what the open ones share
        span = W.partitionBy(*above)
        each = each.withColumn("share", F.max(F.when(~F.col("full"), F.col("budget") - F.col("filled"))).over(span)).withColumn("sharers", F.max(F.when(~F.col("full"), F.col("open"))).over(span))
        to = F.col("sharers") - F.col("open")
        # running parts, rounded down, add up to the whole
        cut = lambda x: F.expr(f"cast(share as decimal(20,0)) * cast({x} as decimal(18,0)) div cast(sharers as decimal(18,0))")
        each = each.withColumn("low", to).withColumn("high", to + F.col("weight"))
        part = F.when(F.col("full"), F.col("capacity")).otherwise(cut("high") - cut("low")).cast("long")
        filled = each.withColumn("part", part).select("root", *LEVELS[:depth], F.col("part").alias("budget"))
        if depth == 3:
            return filled.drop("root").withColumnRenamed("budget", "target")
    raise AssertionError


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, share: float, weights: DataFrame | None = None, epochs: int = EPOCHS, seed: str = SEED, text: str = "text", key: str = "doc_id", domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, tokens, target (of the leaf), copies (at least 1) of the chosen documents.

    ``share``: the budget as a share of all tokens. ``weights`` (domain, lang, source, weight long) may be missing.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(domain if domain is not None else domain_of(F.col("source")), F.lit("")).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), _tokens(F.col(text)).alias("tokens"))
    # the text is read once: later steps read these narrow rows
    units = Settled(rows.groupBy("doc_id", *LEVELS).agg(F.sum("tokens").alias("tokens")), "units").df
    leaves = units.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens"), F.count("*").alias("leaf_docs"))
    if weights is None:
        leaves = leaves.withColumn("weight", F.lit(DEFAULT_WEIGHT).cast("long"))
    else:
        leaves = leaves.join(weights.select(*LEVELS, F.col("weight").cast("long").alias("given")), list(LEVELS), "left").withColumn("weight", F.greatest(F.coalesce("given", F.lit(DEFAULT_WEIGHT)), F.lit(0)).cast("long")).drop("given")
    leaves = Settled(leaves.withColumn("capacity", F.when(F.col("weight") > 0, F.col("leaf_tokens") * epochs).otherwise(0)), "leaves").df
    permille = round(share * 1000)
    budget = F.expr(f"(c div {epochs}) * {permille} div 1000")
    targets = allocate(leaves, budget).join(leaves.select(*LEVELS, "leaf_tokens"), list(LEVELS))
    targets = targets.withColumn("whole", F.expr("CASE WHEN leaf_tokens = 0 THEN 0 ELSE target div leaf_tokens END")).withColumn("left_over", F.col("target") - F.col("whole") * F.col("leaf_tokens"))
    targets = Settled(targets, "targets").df
    buckets = buckets_for(leaves.agg(F.coalesce(F.max("leaf_docs"), F.lit(0))).first()[0], *BUCKETS)
    salted = Spread(leaves, list(LEVELS), "leaf_docs").join(units, targets, "doc_id")
    salted = salted.withColumn("place", hashed(F.lit(seed), F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.expr(f"place * {buckets} div 4294967296"))
    placed = Settled(salted.select("doc_id", *LEVELS, "tokens", "target", "whole", "left_over", "place", "bucket"), "placed").df
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    sums = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("bucket_tokens").over(W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = W.partitionBy(*LEVELS, "bucket").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, [*LEVELS, "bucket"])
    extra = (2 * (F.col("ahead") + F.col("inside")) + F.col("tokens") <= 2 * F.col("left_over")) & (F.col("left_over") > 0)
    copies = (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("int")
    return ranked.select("doc_id", *LEVELS, "tokens", "target", copies.alias("copies")).where("copies > 0")


def keep_mixed(docs: DataFrame, share: float, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, that ``mix`` chooses with one epoch: each once."""
    names = unclashing(docs, "chosen_id", "chosen_lang", "chosen_source")
    chosen = mix(docs, share, epochs=1, text=text, key=key, **options).select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "lang", "source"), names, strict=True)])
    same = F.col(key).eqNullSafe(F.col(names[0]))
    for c, n in zip(("lang", "source"), names[1:], strict=True):
        same = same & (F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(n))
    return docs.join(chosen, same, "left_semi")
