"""Sharding by global byte-size prefix sums [native: DataFrame functions only].

Every row has the size octet_length(text) + 1 (null text: 1). Rows are laid out in one global order: by the
sha-256 of the text, then a salt of the id, then the id. Bucket totals (ranges of the hash, some 50,000 rows each,
BUCKETS[0] to BUCKETS[1] of them, so what is broadcast has a bound) give each
bucket its global byte offset; running sums inside a bucket give each row its own. The line of bytes is cut at
equal targets, and a row goes where its middle lies, so shards are contiguous and differ by about one row.

Equal texts are neighbours. Their group stays in one shard if it has at most GROUP_SHARE of a shard's target or
no more bytes than the largest row has (GROUP_SHARE is a parameter of the law, the same at every size); larger groups
are cut like the rest. Hot groups never meet in one task:
running numbers are taken per (text, salt), and only one row per (text, salt) enters the sums.

Nulls: a null text counts as empty, a null id sorts first. Repeated rows are rows of their own. An empty table
gives an empty result. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.frames import Settled, buckets_for, hashed

BUCKETS = 1024, 1 << 20
SALTS = 64
GROUP_SHARE = 0.02


def assign_shards(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, text_sha256, first_byte, row_number, shard, slot (gapless from 0 in each shard)."""
    content = F.coalesce(F.col(text), F.lit(""))
    # crc32 and sha2 read the text's UTF-8 bytes
    # the text is read once: what follows reads these narrow rows from the shared folder
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"), F.sha2(content.cast("binary"), 256).alias("text_sha256"),
        (hashed(key) % SALTS).alias("salt"),
    )
    rows = Settled(rows, "sizes").df
    buckets = buckets_for(rows.count(), *BUCKETS)
    group = ["text_sha256", "salt"]
    units = rows.groupBy(*group).agg(F.count("*").alias("n"), F.max("size").alias("size"))
    units = units.select(*group, "size", "n", (F.col("size") * F.col("n")).alias("unit_bytes"), F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long").alias("h"))
    units = units.withColumn("bucket", F.expr(f"h * {buckets} div 4294967296"))
    # one row per bucket: BUCKETS[1] rows at most meet in one task and are sent to all
    totals = units.groupBy("bucket").agg(F.sum("unit_bytes").alias("b"), F.sum("n").alias("c"), F.max("size").alias("m"))
    before, everything = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    totals = totals.select(
        "bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bucket_byte"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("bucket_row"),
        F.sum("b").over(everything).alias("total"), F.max("m").over(everything).alias("largest"),
    )
    ahead = W.partitionBy("bucket").orderBy(*group).rowsBetween(W.unboundedPreceding, -1)
    same = W.partitionBy("bucket", "text_sha256")
    units = (
        units.withColumn("unit_byte", F.coalesce(F.sum("unit_bytes").over(ahead), F.lit(0))).withColumn("unit_row", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .withColumn("group_bytes", F.sum("unit_bytes").over(same)).withColumn("group_byte", F.min("unit_byte").over(same))
        .join(F.broadcast(totals), "bucket")
        .select(
            *group, (F.col("bucket_byte") + F.col("unit_byte")).alias("unit_byte"), (F.col("bucket_row") + F.col("unit_row")).alias("unit_row"),
            (F.col("bucket_byte") + F.col("group_byte")).alias("group_byte"), "group_bytes", "total", "largest",
        )
    )
    nth = F.row_number().over(W.partitionBy(*group).orderBy("doc_id")) - 1
    placed = rows.withColumn("nth", nth).join(units, group)
    first = F.col("unit_byte") + F.col("nth") * F.col("size")
    together = F.col("group_bytes") <= F.greatest(F.col("largest").cast("double"), F.lit(GROUP_SHARE) * F.col("total") / shards)
    middle = F.when(together, 2 * F.col("group_byte") + F.col("group_bytes")).otherwise(2 * first + F.col("size"))
    placed = placed.select(
        "doc_id", "size", "text_crc32", "text_sha256", first.alias("first_byte"), (F.col("unit_row") + F.col("nth")).cast("long").alias("row_number"),
        F.least(middle.cast("decimal(38,0)") * shards / (2 * F.col("total")).cast("decimal(20,0)"), F.lit(shards - 1)).cast("int").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row_number").alias("shard_row"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", (F.col("row_number") - F.col("shard_row")).cast("long")).drop("shard_row")
