"""Queries of the operators of this folder: thin digests of the operators' results, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import clustering, decontamination, html_text, language_model, media, mixing, neardup, personal, pulearning, quality, sharding, spelling, token_counts
from tideline.llm.frames import hashed, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def edit_script() -> F.Column:
    """Three edits of each text, by its length and id: a word put into the middle, the first 20 characters taken out, the last changed."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("int")
    edit = lambda a, b, t: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"), t.alias("text"))
    return F.array(
        edit(n / 2, n / 2, F.concat(F.lit(" edit"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("!"))),
        edit(F.lit(0), F.lit(20), F.lit("")), edit(F.greatest(n - 30, F.lit(0)), F.greatest(n - 25, F.lit(0)), F.lit("it's  ")),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), edit_script())


def target_weights(docs: DataFrame) -> DataFrame:
    """The table of target weights: 1 to 5 for each domain, language and source, by a hash of the last two."""
    leaves = docs.select(mixing.domain_of(F.col("source")).alias("domain"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    return leaves.withColumn("weight", 1 + hashed(F.lit("weight"), "lang", "source") % 5)


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, share=0.75, weights=target_weights(docs))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.store_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_keyframes")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pulearning.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal.find_personal(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in personal.BASE], "base_sha256", "spans")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_sharding, op2_toxicity, op3_quality_classifier, op4_benchmark_decontamination, op5_html_extraction, op6_token_counts, op7_mixing_sources, op8_lm_scoring, op9_media_columns, op10_minhash_near_dedup, op11_centroid_clustering, op12_pii, op13_spelling_variants]
    return {f.__name__: f for f in own}
