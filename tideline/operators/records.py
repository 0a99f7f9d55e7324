"""Nested and loosely typed records: allow-lists, paths, references to evidence, claims in prose, masking, packing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A reference to a day's field and an explicit statement about one (fixed formats).
REFERENCE = r"^d(\d+)\.([a-z_]+)$"
STATEMENTS = (r"d(\d+)\.([a-z_]+)\s*(?:=|is|at)\s*(\d+(?:\.\d+)?)", r"\b(?:d|day\s*)(\d+)\s*,?\s+(?:where\s+)?([a-z_]+)\s+(?:is|=)\s*(\d+(?:\.\d+)?)")


def allowed(df: DataFrame, names: list[str]) -> DataFrame:
    """The allowed columns that exist, in the list's order; all others are left out."""
    return df.select(*[n for n in names if n in df.columns])


def without_fields(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    return df.withColumn(column, F.col(column).dropFields(*fields))


def at_path(document: Column, path: str) -> tuple[Column, Column]:
    """(value as text, status found, null or absent) at a dotted path of a JSON text; numbers step into arrays."""
    steps = "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in path.split("."))
    found = F.try_variant_get(F.try_parse_json(document), f"${steps}", "variant")
    status = F.when(found.isNull(), "absent").when(F.is_variant_null(found), "null").otherwise("found")
    return F.try_variant_get(F.try_parse_json(document), f"${steps}", "string"), status


def decoded_array(c: Column) -> Column:
    """An array of texts that a text holds as JSON; null if it is no array."""
    return F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("ARRAY"), F.from_json(c, "array<string>"))


def fenced(c: Column) -> Column:
    """The JSON text of an answer: the whole of it, or the only fenced block in it; null if it doesn't parse or has several."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    body = F.when(F.size(blocks) == 0, bare(c)).when(F.size(blocks) == 1, bare(F.element_at(blocks, 1)))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def masked(df: DataFrame, pattern: str, mask: str) -> DataFrame:
    """Every text, at any depth, with the matches of the pattern replaced."""

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.regexp_replace(c, pattern, mask)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, x: walk(x, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) with one row per metric."""
    return df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def citable(long: DataFrame, keys: list[str], day: str = "n") -> DataFrame:
    """(keys, ref) of all values that may be cited: those that are known."""
    return long.where("value IS NOT NULL").select(*keys, F.concat(F.lit("d"), day, F.lit("."), "metric").alias("ref"))


def resolved(refs: DataFrame, long: DataFrame, keys: list[str], day: str = "n", zero_is_missing: tuple[str, ...] = ()) -> DataFrame:
    """refs (keys, ref) with the value and the status: exists, unusable (null, or a zero that means missing) or invalid."""
    parsed = refs.withColumn("at", F.regexp_extract("ref", REFERENCE, 1).try_cast("int")).withColumn("metric", F.regexp_extract("ref", REFERENCE, 2))
    known = long.select(*keys, F.col(day).cast("int").alias("at"), "metric", "value", F.lit(True).alias("known"))
    both = parsed.join(known, [*keys, "at", "metric"], "left")
    bad = F.col("value").isNull() | (F.col("metric").isin(list(zero_is_missing)) & (F.col("value") == 0))
    return both.withColumn("status", F.when(F.col("known").isNull(), "invalid").when(bad, "unusable").otherwise("exists")).drop("known", "at", "metric")


def statements(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, at, metric, claimed) of the explicit statements in a text."""

    def found(pattern: str) -> Column:
        part = lambda x: F.struct(*[F.regexp_extract(x, pattern, k).alias(n) for k, n in ((1, "at"), (2, "metric"), (3, "claimed"))])
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), part)

    hits = F.concat(*map(found, STATEMENTS))
    return df.select(*keys, F.explode(hits).alias("s")).select(*keys, F.col("s.at").cast("int").alias("at"), "s.metric", F.col("s.claimed").cast("double").alias("claimed"))


def false_statements(claims: DataFrame, long: DataFrame, keys: list[str], day: str = "n", tolerance: float = 0.11) -> DataFrame:
    """Claims that no value or another value stands against, with the other days on which the claim would hold."""
    known = long.select(*keys, F.col(day).cast("int").alias("at"), "metric", F.col("value").alias("actual"))
    wrong = claims.join(known, [*keys, "at", "metric"], "left").where(~F.coalesce(F.abs(F.col("actual") - F.col("claimed")) <= tolerance, F.lit(False)))
    other = known.select(*keys, F.col("at").alias("other"), "metric", F.col("actual").alias("there"))
    near = wrong.join(other, [*keys, "metric"], "left").withColumn("other", F.when(F.abs(F.col("there") - F.col("claimed")) < tolerance, F.col("other")))
    return near.groupBy(*keys, "at", "metric", "claimed", "actual").agg(F.array_sort(F.collect_set("other")).alias("same_value_days"))


def conditions(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, ref ``field.index``, text) of a map from fields to arrays of texts."""
    fields = df.select(*keys, F.explode(column).alias("field", "texts"))
    return fields.select(*keys, "field", F.posexplode("texts").alias("k", "text")).select(*keys, F.concat_ws(".", "field", F.col("k").cast("string")).alias("ref"), "text")


def with_placeholders(answers: DataFrame, expected: DataFrame, keys: list[str], fill: dict[str, str]) -> DataFrame:
    """All expected keys: an answer that is missing, or lacks a field, gets the placeholder."""
    rows = expected.select(*keys).distinct().join(answers, keys, "left")
    return rows.select(*keys, *[F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in answers.columns if c not in keys])


def coded(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """(keys, dictionary, codes): the labels of a group in order, as places (from 0) in the sorted distinct labels."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("dictionary"), F.array_sort(F.collect_list(F.struct(*order, label))).alias("rows"))
    return packed.select(*keys, "dictionary", F.transform("rows", lambda x: F.array_position("dictionary", x[label]).cast("int") - 1).alias("codes"))


def ordered_pairs(df: DataFrame, left: str, right: str, relation: str, flips: dict[str, str]) -> DataFrame:
    """The lesser id left; a relation that names a side changes with the sides."""
    turned = F.col(left) > F.col(right)
    flip = F.coalesce(F.create_map(*[F.lit(x) for kv in flips.items() for x in kv])[F.col(relation)], F.col(relation))
    return df.withColumn("_r", F.when(turned, flip).otherwise(F.col(relation))).withColumn("_a", F.least(left, right)).withColumn("_b", F.greatest(left, right)).withColumn(left, F.col("_a")).withColumn(right, F.col("_b")).withColumn(relation, F.col("_r")).drop("_a", "_b", "_r")


def flags(**tests: Column) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def numbered(df: DataFrame, scope: list[str], seed: str, key: str, buckets: int = 256) -> DataFrame:
    """``place`` from 0 in each scope, in the order of md5(seed, key). Places are counted within buckets of the hash, after
    the buckets' totals, so that a large scope is spread over all tasks."""
    h = F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))
    rows = df.withColumn("_h", h).withColumn("_b", F.expr(f"cast(conv(substring(_h, 1, 4), 16, 10) as int) * {buckets} div 65536"))
    totals = rows.groupBy(*scope, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*scope).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(s).alias(f"_s_{s}") for s in scope], F.col("_b").alias("_c"), before.alias("_ahead"))
    same = F.col("_b") == F.col("_c")
    for s in scope:
        same = same & F.col(s).eqNullSafe(F.col(f"_s_{s}"))
    inside = F.row_number().over(W.partitionBy(*scope, "_b").orderBy("_h", key)) - 1
    return rows.withColumn("_i", inside).join(totals, same).withColumn("place", (F.col("_ahead") + F.col("_i")).cast("long")).drop("_h", "_b", "_c", "_i", "_ahead", *[f"_s_{s}" for s in scope])


def blinded(df: DataFrame, scope: list[str], key: str, seed: str, prefix: str) -> DataFrame:
    """(scope, key, ref): anonymous references, numbered from 1 in a seeded order within each scope."""
    return numbered(df.select(*scope, key).distinct(), scope, seed, key).select(*scope, key, F.format_string(f"{prefix}%03d", F.col("place") + 1).alias("ref"))


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group: the latest revision, the preferred file, the first window of a subject."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def packed(df: DataFrame, keys: list[str], order: list[Column], size: Column, item: str, budget: int) -> DataFrame:
    """(keys, used, kept): items in order, each taken if it still fits; what doesn't fit is passed over."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(item).alias("item"), size.cast("long").alias("size")))).alias("t"))
    kind = df.schema[item].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("kept"))
    step = lambda acc, x: F.when(acc["used"] + x["size"] <= budget, F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["kept"], F.array(x["item"])).alias("kept"))).otherwise(acc)
    return rows.select(*keys, F.aggregate("t", start, step).alias("p")).select(*keys, "p.used", F.array_sort("p.kept").alias("kept"))


def halves(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """[from, to) of the parts that a batch falls into when parts over the limit are cut in half; single items stay."""
    open_ = [(0, len(sizes))]
    while open_:
        a, b = open_.pop()
        if b - a > 1 and sum(sizes[a:b]) > limit:
            m = (a + b) // 2
            open_ += [(m, b), (a, m)]
        elif b > a:
            yield a, b


def bisected(df: DataFrame, batch: str, order: str, size: str, limit: int) -> DataFrame:
    """(batch, order, part): batches of a fixed number of items, cut until each part's sizes are within the limit."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        part = [k for k, (a, b) in enumerate(halves(g[size].tolist(), limit)) for _ in range(a, b)]
        return pd.DataFrame({batch: g[batch], order: g[order], "part": part})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (batch, order)}
    return df.select(batch, order, size).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {order} {kinds[order]}, part long")
