"""Strict values: what may not be coerced is null, or a violation; comparisons of nested values; ceilings of requests."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.sources.shared import settled

#: The only offset that stored times may have; token ceilings of a request, framing and prices (fixed values).
OFFSET = "+08:00"
INPUT_CEILING, WINDOW, PER_MESSAGE, PER_REQUEST = 30720, 32768, 128, 256
PRICE_IN, PRICE_OUT = 2.4, 9.6


def timestamp_at(c: Column, offset: str = OFFSET) -> Column:
    """The instant of an ISO text that states exactly this offset, as UTC without a zone; else null."""
    hours, minutes = (int(x) for x in offset[1:].split(":"))
    shift = (hours * 60 + minutes) * (1 if offset[0] == "+" else -1)
    local = F.substring(c, 1, F.length(c) - len(offset)).try_cast("timestamp_ntz")
    return F.when(c.endswith(offset), local - F.make_dt_interval(mins=F.lit(shift)))


def instant(day: Column, minute: Column) -> Column:
    """The time that lies so many minutes after a day's start."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=F.round(minute * 60, 6).cast("decimal(18,6)"))


def parts(total: Column, n: int) -> Column:
    """``n`` whole numbers that add up to the total, none more than one larger than another, larger ones first."""
    q = F.floor(total / n)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (q + (k < total - q * n).cast("int")).cast("long"))


def is_hash(c: Column) -> Column:
    return F.coalesce(F.length(c) == 64, F.lit(False)) & F.coalesce(c.rlike("^[0-9a-f]*$"), F.lit(False))


def boolean(c: Column) -> Column:
    """True or False of a text that is one of four spellings; else null."""
    return F.when(c.isin("True", "true"), True).when(c.isin("False", "false"), False)


def grade(c: Column) -> Column:
    """0, 1 or 2 of a text; else null."""
    return F.when(c.isin("0", "1", "2"), c.cast("int"))


def grade_status(value: Column, status: Column, pending_allowed: bool = False) -> Column:
    """``ok`` where status and grade agree: labeled with a grade, or (if allowed) needs_review without one; else the fault."""
    known = grade(value).isNotNull()
    empty = F.coalesce(value, F.lit("")) == ""
    wait = status == "needs_review"
    return F.when(~known & ~empty, "invalid label").when((status == "labeled") & known, "ok").when(F.lit(pending_allowed) & wait & empty, "ok").otherwise("unresolved")


def bounded_number(c: Column, most: float) -> Column:
    """A finite number from 0 to ``most``; else null. ``c`` is a JSON text, so true and "1" are no numbers."""
    value = F.try_parse_json(c)
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(value, "$", "double"))
    return F.when(~F.isnan(number) & number.between(0, most), number)


def flattened(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """(keys, path, kind, value) of all values in JSON texts, at any depth: a path is an array of steps, so a field's name may hold any
    character. An object's value is its sorted fields, an array's its length. One pass a level, as long as anything is nested."""
    rows = df.select(*keys, F.array(F.lit("$")).alias("path"), F.try_parse_json(document).alias("v"))
    out = None
    while True:
        rows = rows.withColumn("kind", _kind(F.col("v")))
        members = F.when(F.col("kind") == "object", F.map_entries(F.variant_get("v", "$", "map<string,variant>")))
        places = F.when(F.col("kind") == "array", F.transform(F.variant_get("v", "$", "array<variant>"), lambda x, k: F.struct(k.cast("string").alias("key"), x.alias("value"))))
        rows = rows.withColumn("inner", F.coalesce(members, places))
        shape = F.when(F.col("kind") == "object", F.to_json(F.array_sort(F.transform("inner", lambda e: e["key"])))).when(F.col("kind") == "array", F.size("inner").cast("string"))
        leaves = rows.select(*keys, "path", "kind", F.coalesce(shape, F.try_variant_get("v", "$", "string")).alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        below = settled(rows.where("size(inner) > 0").select(*keys, "path", F.explode("inner").alias("e")).select(*keys, F.concat("path", F.array("e.key")).alias("path"), F.to_json("e.value").alias("text")), "level")
        if below.isEmpty():
            return out
        rows = below.select(*keys, "path", F.try_parse_json("text").alias("v"))


def _kind(v: Column) -> Column:
    kind = F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("INVALID"))
    return F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number").otherwise(F.lower(kind))


def _members(kind: Column, v: Column) -> Column:
    """An object's fields, or an array's elements by their places, as one map; each value is wrapped, as it may be null."""
    wrapped = lambda x: F.struct(x.alias("v"))
    fields = F.when(kind == "object", F.transform_values(F.variant_get(v, "$", "map<string,variant>"), lambda k, x: wrapped(x)))
    items = F.when(kind == "array", F.variant_get(v, "$", "array<variant>"))
    places = F.map_from_arrays(F.transform(items, lambda x, k: k.cast("string")), F.transform(items, wrapped))
    return F.coalesce(fields, places)


def compared(df: DataFrame, keys: list[str], actual: str, expected: str, absolute: float = 1e-7, relative: float = 1e-8) -> DataFrame:
    """(keys, path, fault) where two JSON texts differ: other fields or lengths, other kinds (true is no number), numbers
    further apart than allowed, other values. What lies under a differing object or array is not told again. Both texts of a row
    go down together, a pass a level, so nothing is shuffled."""
    rows, out = df.select(*keys, F.array(F.lit("$")).alias("path"), F.col(actual).alias("a"), F.col(expected).alias("e")), None
    while True:
        differing = rows.where(~F.col("a").eqNullSafe(F.col("e")))  # equal texts have nothing to tell at any depth
        rows = differing.select(*keys, "path", F.try_parse_json("a").alias("a"), F.try_parse_json("e").alias("e"))
        rows = rows.select("*", _kind(F.col("a")).alias("k_a"), _kind(F.col("e")).alias("k_e"))
        rows = rows.select("*", _members(F.col("k_a"), F.col("a")).alias("m_a"), _members(F.col("k_e"), F.col("e")).alias("m_e"))
        value = lambda n: F.when(F.col(f"k_{n}") == "object", F.to_json(F.array_sort(F.map_keys(f"m_{n}")))).when(F.col(f"k_{n}") == "array", F.size(f"m_{n}").cast("string")).otherwise(F.try_variant_get(n, "$", "string"))
        told = rows.select(*keys, "path", "k_a", "k_e", value("a").alias("v_a"), value("e").alias("v_e"))
        x, y = F.col("v_a").try_cast("double"), F.col("v_e").try_cast("double")
        near = F.abs(x - y) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(x), F.abs(y)))
        same = (F.col("k_a") == F.col("k_e")) & F.when(F.col("k_e") == "number", near).otherwise(F.col("v_a").eqNullSafe(F.col("v_e")))
        fault = F.when(F.col("k_e") == "object", "fields").when(F.col("k_e") == "array", "length").otherwise("value")
        level = told.where(~F.coalesce(same, F.lit(False))).select(*keys, F.array_join("path", ".").alias("path"), fault.alias("fault"))
        out = level if out is None else out.unionByName(level)
        # paths of one side only show in their parent's fields
        both = F.filter(F.map_entries(F.map_zip_with("m_a", "m_e", lambda k, p, q: F.struct(p.alias("a"), q.alias("e")))), lambda m: m["value"]["a"].isNotNull() & m["value"]["e"].isNotNull())
        inner = rows.select(*keys, "path", F.explode(both).alias("m"))
        below = settled(inner.select(*keys, F.concat("path", F.array("m.key")).alias("path"), F.to_json("m.value.a.v").alias("a"), F.to_json("m.value.e.v").alias("e")), "level")
        if below.isEmpty():
            return out
        rows = below


def contained(root: str, path: str) -> str:
    """The path under the root; one that leads out of it is an error."""
    root = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(root, path))
    if full != root and not full.startswith(f"{root.rstrip('/')}/"):
        raise ValueError(f"{path} is outside of {root}")
    return full


def ceiling(contents: Column, output: Column) -> Column:
    """Of an array of messages' texts: the upper bound of input tokens (bytes and framing), whether the request fits, and what
    it may cost. Nothing is cut: what doesn't fit is refused."""
    upper = F.aggregate(contents, F.lit(0).cast("long"), lambda a, m: a + F.octet_length(F.coalesce(m, F.lit(""))) + PER_MESSAGE) + PER_REQUEST
    fits = (upper <= INPUT_CEILING) & (upper + output <= WINDOW)
    return F.struct(upper.alias("input_ceiling"), fits.alias("fits"), F.when(fits, (upper * PRICE_IN + output * PRICE_OUT) / 1e6).alias("reserved"))


def roster_violations(people: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Rules of rosters (scope, reviewer_id, person_id, role, background, is_human, independent, qualified), one per scope: the two
    reviewers A and B and the adjudicator C are three people, all known, human and independent; C and one of A and B are qualified."""
    from tideline.operators import checks

    scope = list(scope)
    who, told = F.col("reviewer_id"), lambda c: F.coalesce(F.length(F.btrim(c)) > 0, F.lit(False))
    each = {
        "reviewer": who.isin("A", "B", "C"), "person": told("person_id") & told("background"), "human": F.col("is_human") & F.col("independent"),
        "role": F.col("role") == F.when(who == "C", "adjudicator").otherwise("reviewer"), "adjudicator": (who != "C") | F.col("qualified"),
    }
    out = checks.duplicates(people, [*scope, "reviewer_id"]).unionByName(checks.duplicates(people, [*scope, "person_id"]))
    for rule, condition in each.items():
        out = out.unionByName(checks.holds(people, rule, [*scope, "reviewer_id"], condition, F.col("person_id")))
    found = people.groupBy(*scope).agg(F.count_distinct("reviewer_id").alias("n"), F.count_if(who.isin("A", "B") & F.col("qualified")).alias("q")).withColumn("reviewer_id", F.lit("all"))
    return out.unionByName(checks.holds(found, "three", [*scope, "reviewer_id"], F.col("n") == 3, F.col("n"))).unionByName(checks.holds(found, "expertise", [*scope, "reviewer_id"], F.col("q") > 0, F.col("q")))
