"""Retrieval runs: queries of records, rankings per slot, fusion, and their check by computing all again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as words_of
from tideline.operators import checks, retrieval
from tideline.sources.records import Rejected, exists
from tideline.sources.shared import settled

#: Query slots of a record in parts (fixed value).
SLOTS = 5


def queries(records: DataFrame, key: str, in_parts: Column, slots: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, slot, text) of the queries, and violations: records in parts have exactly SLOTS texts that aren't blank, others
    have one text, and none if it is blank."""
    blank = lambda c: F.length(F.btrim(F.coalesce(c, F.lit("")))) == 0
    texts = F.when(in_parts, F.coalesce(slots, F.array().cast("array<string>"))).otherwise(F.when(~blank(F.col(text)), F.array(text)).otherwise(F.array().cast("array<string>")))
    rows = records.select(key, in_parts.alias("in_parts"), texts.alias("texts"))
    bad = ~F.col("in_parts") | ((F.size("texts") == SLOTS) & ~F.exists("texts", blank))
    return rows.select(key, F.posexplode("texts").alias("slot", "text")), checks.holds(rows, "slots", [key], bad, F.size("texts"))


def run(docs: DataFrame, slots: DataFrame, doc: str, key: str, k: int = retrieval.TOP, words: int | None = None) -> DataFrame:
    """(key, doc, score, rank): the rankings of a record's slots, fused. Texts are cut to ``words`` tokens first, if given."""
    from tideline.functions import text

    own = slots.withColumn("run", F.concat_ws("/", key, "slot"))
    if words is not None:
        own = own.withColumn("text", text.truncated(F.col("text"), words))
    ranked = retrieval.bm25(docs, own.select("run", "text"), doc, "run", k=k)
    return retrieval.rrf(ranked.join(own.select("run", key), "run"), [key], doc, k)


def violations(saved: DataFrame, again: DataFrame, key: str, doc: str, k: int = retrieval.TOP, tolerance: float = 1e-9) -> DataFrame:
    """What a saved run breaks: the rules of rankings, and places, items or scores other than those computed again."""
    want = again.select(key, "rank", doc, "score")
    places = checks.same_values(saved, want, [key, "rank", doc], "score", tolerance)
    return checks.ranks(saved, [key], doc, k).unionByName(places)


def links(facts: DataFrame, items: DataFrame, fact: str, alias: str, item: str, text: str) -> DataFrame:
    """(fact, item) where an item's text has an alias as whole words. Ids of facts and items meet on the alias's rarest word; only
    where it has more words is a text fetched, once for each item that is hit, and looked through."""
    own = facts.select(fact, words_of.tokens(alias).alias("a")).where("size(a) > 0")
    asked = own.select(F.explode(F.array_distinct("a")).alias("word")).distinct()
    there = items.select(item, F.explode(F.array_distinct(words_of.tokens(text))).alias("word"))
    there = settled(there.join(asked, "word", "left_semi"), "words")
    often = there.groupBy("word").agg(F.count("*").alias("n"))
    each = own.select(fact, F.explode(F.array_distinct("a")).alias("word")).join(often, "word", "left")
    # a word that no item has is the rarest: it meets nothing
    rarest = each.groupBy(fact).agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("word"))
    met = settled(there.join(rarest, "word").select(fact, item).join(own.select(fact, F.size("a").alias("words"), F.concat(F.lit(" "), F.array_join("a", " "), F.lit(" ")).alias("phrase")), fact), "met")
    several = met.where("words > 1")
    texts = items.join(several.select(item).distinct(), item, "left_semi").select(item, F.concat(F.lit(" "), F.array_join(words_of.tokens(text), " "), F.lit(" ")).alias("whole"))
    found = several.groupBy(item).agg(F.collect_list(F.struct(fact, "phrase")).alias("asked")).join(texts, item)  # facts that share an item's words
    found = found.select(item, F.explode(F.filter("asked", lambda x: F.contains(F.col("whole"), x["phrase"]))).alias("x")).select(f"x.{fact}", item)
    return met.where("words = 1").select(fact, item).union(found).distinct()


def ranked_whole(scores: DataFrame, query: str, item: str) -> DataFrame:
    """(query, item, score, rank) of whole rankings, by falling score, then item. Rows are dealt out by ranges of (query,
    score, item), so a query with many items lies in many partitions; a row's rank is its place in its partition, after the
    totals of the partitions before. No task holds a query's whole ranking."""
    order = [F.col(query), F.desc("score"), F.col(item)]
    rows = scores.select(query, item, "score").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # written once: the places must stay as they are
    rows = settled(rows, "ranges").withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(query, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # partitions + queries
    before = F.coalesce(F.sum("_n").over(W.partitionBy(query).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_ahead", before).drop("_n")
    return rows.join(parts, [query, "_part"]).select(query, item, "score", (F.col("_at") - F.col("_first") + F.col("_ahead") + 1).cast("long").alias("rank"))


class FullRun:
    """A full ranking of every query and the manifest of the run, under a path that must not exist.

    The manifest's counts come from observations of the two writes, so nothing is read again for them: queries, those that
    were cut to ``budget`` tokens, blank ones (they get no ranking), their tokens, rows, documents' hits (scores above 0)
    and the best score. Digests name the inputs: sums of hashes over rows, whatever their order.

    ``rerank``, if given, gets the first ``pool`` of each ranking (query, doc) and gives other scores (query, doc, score), in whose
    order they are put; that arm (``reranked``) has the pool only, and the two scores are never mixed."""

    def __init__(self, docs: DataFrame, queries: DataFrame, doc: str, query: str, path: str, method: str = "bm25", budget: int = 512, text: str = "text", rerank: Callable[[DataFrame], DataFrame] | None = None, pool: int = retrieval.TOP):
        if exists(docs.sparkSession, path):
            raise Rejected(f"{path} exists; choose a new version")
        if method != "bm25":
            raise ValueError(f"unknown method {method}")
        self.spark, self.path = docs.sparkSession, path.rstrip("/")
        asked, ranked = Observation("queries"), Observation("rankings")
        digest = lambda *c: F.coalesce(F.sum(F.xxhash64(*c).cast("decimal(38,0)")), F.lit(0)).cast("string")
        tokens = F.size(words_of.tokens(F.coalesce(text, F.lit(""))))
        prepared = queries.select(query, words_of.truncated(F.coalesce(text, F.lit("")), budget).alias("text"), tokens.alias("tokens")).withColumn("truncated", F.col("tokens") > budget)
        prepared = prepared.observe(
            asked, F.count("*").alias("queries"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("tokens") == 0).alias("blank"),
            F.coalesce(F.sum(F.least("tokens", F.lit(budget))), F.lit(0)).alias("query_tokens"), digest(query, "text").alias("queries_digest"),
        )
        prepared.write.parquet(f"{self.path}/queries")
        self.queries = self.spark.read.parquet(f"{self.path}/queries")
        scores = retrieval.bm25_scores(docs.select(doc, text), self.queries.select(query, "text"), doc, query)
        full = ranked_whole(scores, query, doc).observe(ranked, F.count("*").alias("rows"), F.count_if(F.col("score") > 0).alias("hits"), F.max("rank").alias("corpus"), F.max("score").alias("best_score"))
        full.write.parquet(f"{self.path}/rankings")
        self.rankings = self.spark.read.parquet(f"{self.path}/rankings")
        self.reranked = None
        if rerank is not None:
            first = self.rankings.where(F.col("rank") <= pool)
            retrieval.reranked(first, rerank(first.select(query, doc)), [query], doc, pool).write.parquet(f"{self.path}/reranked")
            self.reranked = self.spark.read.parquet(f"{self.path}/reranked")
        facts = {"method": method, "query_budget": budget, "pool": None if rerank is None else pool, "tie_breaking": f"{doc} ascending", **asked.get, **ranked.get}
        kinds = {"queries_digest": "string", "best_score": "double", "method": "string", "tie_breaking": "string"}
        self.spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} {kinds.get(k, 'long')}" for k in facts)).coalesce(1).write.parquet(f"{self.path}/manifest")
        self.manifest = self.spark.read.parquet(f"{self.path}/manifest")
