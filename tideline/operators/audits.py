"""Audits of stored judgments, sources and texts: like ``checks``, one row (rule, key, detail) per violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import checks

#: Allowed labels (fixed values).
ROLES = ("necessary_prerequisite", "optional_background", "claim_scope_restriction", "disputed")
SUPPORT = ("EXPLICIT_SUPPORT", "GENERAL_ADVICE_ONLY", "OVERINTERPRETED", "UNVERIFIABLE")
TOPICS = ("related", "not_related", "uncertain")
LABELS = ("applicable", "not_applicable", "insufficient_information")
CONDITION_STATUS = ("satisfied", "violated", "unknown", "not_applicable_to_condition")
#: A time stamp that ends in an offset or Z.
ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def filled(c: str) -> Column:
    return F.length(F.btrim(F.coalesce(F.col(c), F.lit("")))) > 0


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sources(checked: DataFrame, expected: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """checked: (source_id, condition_id, original_text, role, support, evidence: array of (paragraph_id, quote)); expected:
    (source_id, condition_id, text); paragraphs: (source_id, paragraph_id, text).

    Every expected condition is checked once and no other; its text is unchanged; role and support are known labels; whatever
    isn't UNVERIFIABLE has evidence; every quote stands in the paragraph it names."""
    keys = ["source_id", "condition_id"]
    both = checked.join(expected.withColumnRenamed("text", "want"), keys)
    cited = checked.select(*keys, F.posexplode("evidence").alias("place", "e")).select(*keys, "place", "e.paragraph_id", "e.quote")
    cited = cited.join(paragraphs.withColumnRenamed("text", "paragraph"), ["source_id", "paragraph_id"], "left")
    return _all([
        checks.duplicates(checked, keys), checks.missing(checked, expected, keys), checks.unexpected(checked, expected, keys),
        checks.holds(both, "text", keys, F.col("original_text").eqNullSafe(F.col("want")), F.lit("changed")),
        checks.holds(checked, "role", keys, F.col("role").isin(*ROLES), F.col("role")),
        checks.holds(checked, "support", keys, F.col("support").isin(*SUPPORT), F.col("support")),
        checks.holds(checked, "evidence", keys, (F.col("support") == "UNVERIFIABLE") | (F.size("evidence") > 0), F.lit("none")),
        checks.holds(cited, "quote", [*keys, "place"], filled("quote") & F.contains("paragraph", F.col("quote")), F.lit("not in paragraph")),
    ])


def submissions(records: DataFrame, key: str, reviewer: str, release: str) -> DataFrame:
    """Complete, attested submissions of one reviewer for one release, with a time of completion that states its zone."""
    return _all([
        checks.duplicates(records, [key]),
        checks.holds(records, "status", [key], F.col("status") == "complete", F.col("status")),
        checks.holds(records, "attestation", [key], F.col("human_attestation"), F.lit("absent")),
        checks.holds(records, "reviewer", [key], F.col("reviewer_id") == reviewer, F.col("reviewer_id")),
        checks.holds(records, "release", [key], F.col("release_id") == release, F.col("release_id")),
        checks.holds(records, "zone", [key], F.rlike("completed_at", F.lit(ZONED)), F.col("completed_at")),
    ])


def judged_items(items: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """items: (case_id, candidate, applicability, topic, rationale, conditions, observations, missing, judgments: array of
    (condition_id, status, rationale)); expected: (case_id, candidate, known: array of condition ids); observed: (case_id, ref)
    of all usable values.

    Every candidate once; topic and applicability each a known label; a rationale and citations of known conditions; only
    observed values cited, at least one for a definite label; what is missing for an indefinite one; and one status with a
    rationale for every known condition."""
    keys = ["case_id", "candidate"]
    rows = items.join(expected, keys)
    ids = F.transform("judgments", lambda j: j.condition_id)
    whole = (F.size("judgments") == F.size("known")) & (F.size(F.array_except("known", ids)) == 0) & (F.size(F.array_except(ids, F.col("known"))) == 0)
    stated = F.forall("judgments", lambda j: j.status.isin(*CONDITION_STATUS) & (F.length(F.btrim(j.rationale)) > 0))
    refs = items.select(*keys, F.explode(F.array_distinct("observations")).alias("ref"))
    definite = F.col("applicability").isin("applicable", "not_applicable")
    return _all([
        checks.duplicates(items, keys), checks.missing(items, expected, keys), checks.unexpected(items, expected, keys),
        checks.holds(rows, "label", keys, F.col("applicability").isin(*LABELS), F.col("applicability")),
        checks.holds(rows, "topic", keys, F.col("topic").isin(*TOPICS), F.col("topic")),
        checks.holds(rows, "rationale", keys, filled("rationale"), F.lit("empty")),
        checks.holds(rows, "citation", keys, (F.size("conditions") > 0) & (F.size(F.array_except("conditions", "known")) == 0), F.lit("unknown condition")),
        checks.holds(rows, "observed", keys, ~definite | (F.size("observations") > 0), F.lit("nothing cited")),
        checks.holds(rows, "missing_information", keys, definite | (F.size("missing") > 0), F.lit("not described")),
        checks.holds(rows, "judgments", keys, whole & stated, F.lit("incomplete")),
        checks._out(refs.join(observed.select("case_id", "ref").distinct(), ["case_id", "ref"], "left_anti"), "evidence", [*keys, "ref"], F.lit("not observed")),
    ])


def annotations(a: DataFrame, b: DataFrame, final: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """a, b: (keys, relevance, status, input_sha256) of two judges, pending ones with a null relevance; final: (keys, relevance,
    judge_a, judge_b, judges_agreed, changed_agreement); gold: (keys, relevance).

    All four have the same pairs once; gold is the final label; the final rows repeat the judges' labels; the judges had
    different inputs; and both flags are those that follow from the labels."""
    named = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
    rows = named(final, "f").join(named(a, "a"), keys).join(named(b, "b"), keys).join(named(gold, "g"), keys)
    agreed = F.coalesce(F.col("a_relevance") == F.col("b_relevance"), F.lit(False))
    parts = [checks.duplicates(df, keys) for df in (a, b, final, gold)]
    for df in (a, b, gold):
        parts += [checks.missing(df, final, keys), checks.unexpected(df, final, keys)]
    same = lambda rule, left, right: checks.holds(rows, rule, keys, F.col(left).eqNullSafe(right), F.concat_ws(" <> ", F.coalesce(F.col(left).cast("string"), F.lit("null")), F.coalesce(right.cast("string"), F.lit("null"))))
    return _all([
        *parts, same("gold", "g_relevance", F.col("f_relevance")), same("judge_a", "f_judge_a", F.col("a_relevance")), same("judge_b", "f_judge_b", F.col("b_relevance")),
        same("agreed", "f_judges_agreed", agreed), same("changed", "f_changed_agreement", agreed & ~F.col("f_relevance").eqNullSafe(F.col("a_relevance"))),
        checks.holds(rows, "inputs", keys, F.col("a_input_sha256") != F.col("b_input_sha256"), F.lit("the same")),
    ])


def representations(records: DataFrame, expected: DataFrame, inputs: DataFrame, budget: int, in_parts: str, plain: str) -> DataFrame:
    """records: (case_id, method, repeat, status, input_sha256, text, queries, tokens, counted); expected: (case_id, method,
    repeat); inputs: (case_id, sha256, facts).

    The full matrix once; completed; made from the case's one input; never blank; texts of method ``in_parts`` are its joined
    queries, other methods have no queries; stated token counts are the counted ones and fit the budget, but for method
    ``plain``, whose text is the case's facts."""
    keys = ["case_id", "method", "repeat"]
    rows = records.join(inputs.select("case_id", "sha256", "facts"), "case_id")
    joined = F.col("text").eqNullSafe(F.btrim(F.concat_ws("\n", "queries")))
    of = lambda m: F.col("method") == m
    return _all([
        checks.duplicates(records, keys), checks.missing(records, expected, keys), checks.unexpected(records, expected, keys),
        checks.holds(rows, "status", keys, F.col("status") == "completed", F.col("status")),
        checks.holds(rows, "input", keys, F.col("input_sha256") == F.col("sha256"), F.lit("changed")),
        checks.holds(rows, "text", keys, filled("text"), F.lit("empty")),
        checks.holds(rows, "queries", keys, F.when(of(in_parts), joined & (F.size("queries") > 0)).otherwise(F.coalesce(F.size("queries"), F.lit(0)) <= 0), F.lit("differ")),
        checks.holds(rows, "tokens", keys, F.col("tokens") == F.col("counted"), F.col("tokens")),
        checks.holds(rows, "budget", keys, of(plain) | (F.col("counted") <= budget), F.col("counted")),
        checks.holds(rows, "facts", keys, ~of(plain) | F.col("text").eqNullSafe(F.col("facts")), F.lit("not the facts")),
    ])


def rounds(records: DataFrame, plan: DataFrame, by: list[str], item: str) -> DataFrame:
    """Rounds in which the number of different items isn't the planned one; a round without records has none. plan: (by, expected)."""
    have = records.groupBy(*by).agg(F.count_distinct(item).alias("have"))
    both = plan.join(have, by, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return checks.holds(both, "round", by, F.col("have") == F.col("expected"), F.concat_ws(" of ", F.col("have").cast("string"), F.col("expected").cast("string")))


def claims(stated: DataFrame, long: DataFrame, keys: list[str], baseline: int, zero_is_missing: tuple[str, ...] = (), tolerance: float = 0.0011) -> DataFrame:
    """stated: (keys, n, metric, value, phase, purpose) observations that a judgment cites; long: (keys, n, metric, value).

    The day and metric exist; the value is that one (two nulls are equal) and the phase that of the day; a value that is missing,
    or zero in ``zero_is_missing``, is cited for missingness only."""
    at = [*keys, "n", "metric"]
    rows = stated.join(long.withColumnRenamed("value", "actual").withColumn("known", F.lit(True)), at, "left")
    found = rows.where("known")
    near = F.coalesce(F.abs(F.col("value") - F.col("actual")) < tolerance, F.col("value").isNull() & F.col("actual").isNull())
    usable = F.col("actual").isNotNull() & ~(F.col("metric").isin(*zero_is_missing) & (F.col("actual") == 0))
    return _all([
        checks.holds(rows, "observation", at, F.col("known"), F.lit("absent")), checks.holds(found, "value", at, near, F.lit("differs")),
        checks.holds(found, "phase", at, F.col("phase") == F.when(F.col("n") <= baseline, "baseline").otherwise("current"), F.col("phase")),
        checks.holds(found, "unusable", at, usable | F.col("purpose").eqNullSafe("missingness"), F.col("purpose")),
    ])


def united(left: DataFrame, right: DataFrame, key: str, agree: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items of both sides by id, the left one first, and violations: ids whose columns in ``agree`` differ."""
    b = right.select(F.col(key), F.struct(*right.columns).alias("_r"))
    both = left.select(F.col(key), F.struct(*left.columns).alias("_l")).join(b, key, "full_outer")
    out = both.select(F.coalesce("_l", "_r").alias("x")).select("x.*")
    same = reduce(lambda x, y: x & y, [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in agree])
    return out, checks.holds(both.where("_l IS NOT NULL AND _r IS NOT NULL"), "union", [key], same, F.lit("differ"))
