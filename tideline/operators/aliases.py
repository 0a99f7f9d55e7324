"""Aliases of ids inside nested records: what is proven one-to-one is written back, everything else is told and left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.sources.files import slots


def proven(proofs: DataFrame, scope: str, alias: str, target: str) -> DataFrame:
    """(scope, alias, target, fault) of all pairs that were seen: the fault is null where, within the scope, the alias has one target
    and the target one alias, counted both ways. Nulls on either side prove nothing."""
    told = proofs.where(F.col(scope).isNotNull() & F.col(alias).isNotNull() & F.col(target).isNotNull()).select(scope, alias, F.col(target).cast("string").alias(target))
    n = slots(told)
    counted = lambda rows, *by: rows.withColumn(f"_{by[1]}", F.count("*").over(W.partitionBy(*by)))
    pairs = counted(told.repartition(n, scope, alias).distinct(), scope, alias)
    pairs = counted(pairs.repartition(n, scope, target), scope, target)
    fault = F.when(F.col(f"_{alias}") > 1, "ambiguous alias").when(F.col(f"_{target}") > 1, "shared target")
    return pairs.select(scope, alias, target, fault.alias("fault"))


def _walk(c: Column, kind: T.DataType, fields: set[str], name: str, change) -> Column:
    if isinstance(kind, T.StringType):
        return change(c) if name in fields else c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _walk(x, kind.elementType, fields, name, change))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_walk(c[f.name], f.dataType, fields, f.name, change).alias(f.name) for f in kind.fields]))
    return c


def _found(c: Column, kind: T.DataType, fields: set[str], name: str) -> Column | None:
    """All texts of the fields, as one array."""
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(c)) if name in fields else None
    if isinstance(kind, T.ArrayType):
        probe = _found(F.lit(None).cast(kind.elementType), kind.elementType, fields, name)
        if probe is None:
            return None
        return F.coalesce(F.flatten(F.transform(c, lambda x: F.coalesce(_found(x, kind.elementType, fields, name), F.array().cast("array<string>")))), F.array().cast("array<string>"))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _found(c[f.name], f.dataType, fields, f.name)) is not None]
        return F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]) if parts else None
    return None


def rewritten(docs: DataFrame, scope: str, column: str, fields: list[str], pattern: str, proofs: DataFrame, alias: str, target: str) -> DataFrame:
    """The documents with the aliases in ``fields``, at any depth of ``column``, replaced by their targets, and ``unproven``:
    the aliases (texts that match the pattern) without proof in the document's scope, sorted. A document with any such alias stays as it
    was. Other texts in the fields stay. A scope's aliases are those of one index and go with its documents as one map."""
    names, kind = set(fields), docs.schema[column].dataType
    good = proven(proofs, scope, alias, target).where("fault IS NULL")
    n = slots(docs, proofs)
    maps = good.repartition(n, scope).groupBy(scope).agg(F.map_from_entries(F.collect_list(F.struct(F.col(alias), F.col(target)))).alias("_map"))
    rows = docs.repartition(n, scope).join(maps, scope, "left")
    used = _found(F.col(column), kind, names, column)
    if used is None:
        raise ValueError(f"{column} has none of the fields {fields}")
    asked = F.array_sort(F.array_distinct(F.filter(F.coalesce(used, F.array().cast("array<string>")), lambda x: F.rlike(x, F.lit(pattern)))))
    known = F.coalesce(F.map_keys("_map"), F.array().cast("array<string>"))
    rows = rows.withColumn("unproven", F.array_except(asked, known))
    new = _walk(F.col(column), kind, names, column, lambda c: F.coalesce(F.when(F.rlike(c, F.lit(pattern)), F.element_at("_map", c)), c))
    return rows.withColumn(column, F.when((F.size("unproven") == 0) & F.col("_map").isNotNull(), new).otherwise(F.col(column))).drop("_map")
