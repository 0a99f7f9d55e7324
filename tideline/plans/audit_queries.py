"""Queries of views, facts, shares and audits, each with its SQL. Where a table has no such records they are made from its
rows, with faults at stated ids, and the SQL lists those faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import audits, cases, checks, judging, records, timeseries, values, views
from tideline.plans import oracles as base
from tideline.plans.queries import END, START, _daily, _spans, r
from tideline.plans.record_queries import query
from tideline.sources.files import table

BASELINE, FIRST, HALF = 16, 17, 7
METRICS = ["value", "events", "clicks"]

_GRID = base._DAILY + """, grid AS (SELECT user_id, k::INTEGER AS n, DATE '2024-01-01' + (k::INTEGER - 1) AS day FROM (SELECT DISTINCT user_id FROM events), range(1, 31) t(k)),
wide AS (SELECT g.user_id, g.n, g.day, d.value, d.events, d.clicks FROM grid g LEFT JOIN daily d ON d.user_id = g.user_id AND d.day = g.day),
long AS (SELECT user_id, n, day, unnest(['value', 'events', 'clicks']) AS metric, unnest([value, events, clicks]) AS value FROM wide)"""


def _wide(spark, d):
    days = timeseries.densify(_daily(spark, d), ["user_id"], START, END)
    return days.withColumn("n", F.datediff("day", F.lit(START).cast("date")) + 1)


def _long(spark, d):
    return records.long_form(_wide(spark, d), ["user_id", "n"], METRICS)


# --- views of a case ------------------------------------------------------------------------------------------------------

_VIEW = _GRID + f""", u AS (SELECT user_id, n, metric, CASE WHEN n <= {BASELINE} THEN 'baseline' ELSE 'current' END AS phase, CASE WHEN metric = 'clicks' AND value = 0 THEN NULL ELSE value END AS v FROM long),
s AS (SELECT a.*, abs(a.v - b.v) AS step, CASE WHEN a.v IS NOT NULL THEN a.n::DOUBLE END AS x FROM u a LEFT JOIN u b ON b.user_id = a.user_id AND b.metric = a.metric AND b.phase = a.phase AND b.n = a.n - 1),
stats AS (SELECT user_id, phase, metric, min(n) AS first_day, max(n) AS last_day, count(v) AS n, count(*) - count(v) AS missing, avg(v) AS mean, median(v) AS median, stddev_pop(v) AS sd, min(v) AS min, max(v) AS max,
covar_pop(x, v) / nullif(var_pop(x), 0) AS slope_per_day, avg(step) AS adjacent_change FROM s GROUP BY 1, 2, 3)"""
_STATS = ["mean", "median", "sd", "min", "max", "slope_per_day", "adjacent_change"]


def _statistics(spark, d, mode="statistics"):
    return views.view(_long(spark, d), ["user_id"], mode, BASELINE, ("clicks",))


@query(f"WITH {_VIEW} SELECT user_id, phase, metric, first_day, last_day, n, missing, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in _STATS)} FROM stats")
def view_statistics(spark, d):
    """Zero is added so that no negative zero is left."""
    return _statistics(spark, d).select("user_id", "phase", "metric", "first_day", "last_day", "n", "missing", *[(r(c) + F.lit(0.0)).alias(c) for c in _STATS])


@query(f"WITH {_VIEW} SELECT user_id, metric, n, missing, round(mean, 6) AS mean FROM stats WHERE phase = 'current'")
def view_current(spark, d):
    return _statistics(spark, d, "current").select("user_id", "metric", "n", "missing", r("mean").alias("mean"))


_TWO = "coalesce(regexp_replace({}::DECIMAL(30, 9)::DECIMAL(30, 2)::VARCHAR, '0$', ''), 'unknown')"


@query(f"""WITH {_VIEW}, l AS (SELECT user_id, phase, min(first_day) AS a, max(last_day) AS b, string_agg(metric || ': n=' || n || ' mean=' || {_TWO.format('mean')} || ' sd=' || {_TWO.format('sd')} || ' slope/day=' || {_TWO.format('slope_per_day')}, chr(10) ORDER BY metric) AS lines FROM stats GROUP BY 1, 2)
SELECT user_id, 'Daily records.' || chr(10) || string_agg(phase || ' days [' || a || ', ' || b || ']' || chr(10) || lines, chr(10) ORDER BY phase) || chr(10) || 'Missing days are unknown.' AS text FROM l GROUP BY 1""")
def view_query_text(spark, d):
    return views.query_text(_statistics(spark, d), ["user_id"], "Daily records.", "Missing days are unknown.")


@query("""WITH e AS (SELECT user_id, ts::DATE AS day, min(ts) AS ts, count(*) AS k FROM events GROUP BY 1, 2), f AS (SELECT user_id, min(day) AS first FROM e GROUP BY 1)
SELECT user_id, (e.day - f.first + 1)::INTEGER AS n, (DATE '2000-01-03' + (isodow(f.first)::INTEGER - 1) + (e.day - f.first)::INTEGER)::VARCHAR AS date, nullif(k % 3, 0) AS resting,
CASE WHEN k % 5 > 0 THEN strftime((DATE '2000-01-03' + (isodow(f.first)::INTEGER - 1) + (e.day - f.first)::INTEGER - (CASE WHEN hour(ts) >= 18 THEN 1 ELSE 0 END)) + (ts - ts::DATE), '%Y-%m-%d %H:%M:%S') END AS bed_time FROM e JOIN f USING (user_id)""")
def personal_frames(spark, d):
    """Daily rows with made-up dates of the true weekday; a zero is no value; a clock time late in the day is of the day before."""
    days = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts"), F.count("*").alias("k"))
    first = days.groupBy("user_id").agg(F.min("day").alias("first"))
    rows = days.join(first, "user_id").withColumn("n", F.datediff("day", "first") + 1).withColumn("weekday", F.weekday("day") + 1)
    offset = F.when(F.col("k") % 5 > 0, F.when(F.hour("ts") >= 18, -1).otherwise(0))
    at = views.clock_at(F.col("date"), offset, F.date_format("ts", "HH:mm:ss"))
    return views.dated(rows, ["user_id"]).select(
        "user_id", "n", F.col("date").cast("string").alias("date"), F.nullif(F.col("k") % 3, F.lit(0)).alias("resting"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("bed_time"))


# --- families of facts ----------------------------------------------------------------------------------------------------


@query(f"""WITH {_GRID}, m AS (SELECT user_id, metric, avg(value) FILTER (n < {FIRST}) AS b, avg(value) FILTER (n >= {FIRST}) AS w, avg(value) FILTER (n >= {FIRST} AND n < {FIRST + HALF}) AS h1, avg(value) FILTER (n >= {FIRST + HALF}) AS h2,
avg(value) FILTER (n >= {FIRST} AND isodow(day) < 6) AS d, avg(value) FILTER (n >= {FIRST} AND isodow(day) >= 6) AS e, count(*) FILTER (n >= {FIRST} AND value IS NULL) AS gone FROM long GROUP BY 1, 2 HAVING w IS NOT NULL),
ev AS (SELECT user_id, event_type, (ts::DATE - DATE '2024-01-01' + 1)::INTEGER AS n, ts, floor(value) AS minutes FROM events),
t AS (SELECT user_id, min(k) AS a, max(k) AS b FROM (SELECT user_id, (hour(ts) * 60 + minute(ts) + 720) % 1440 AS k FROM ev WHERE event_type = 'signup' AND n >= {FIRST}) GROUP BY 1),
i AS (SELECT user_id, avg(x) AS m FROM (SELECT user_id, n, max(minutes) AS x FROM ev WHERE event_type = 'view' AND n >= {FIRST} GROUP BY 1, 2) GROUP BY 1 HAVING m IS NOT NULL),
late AS (SELECT DISTINCT user_id, n FROM ev WHERE event_type = 'click' AND hour(ts) >= 18 AND n >= {FIRST} AND n <= 30),
al AS (SELECT a.user_id, bool_or(l.n IS NOT NULL) AS seen, avg(b.value) FILTER (l.n IS NOT NULL) AS x, avg(b.value) FILTER (l.n IS NULL) AS y FROM wide a LEFT JOIN wide b ON b.user_id = a.user_id AND b.n = a.n + 1 LEFT JOIN late l ON l.user_id = a.user_id AND l.n = a.n WHERE a.n >= {FIRST} GROUP BY 1),
ex AS (SELECT user_id, max(events) AS hi, min(value) AS lo FROM wide WHERE n < {FIRST} GROUP BY 1 HAVING hi IS NOT NULL AND lo IS NOT NULL),
o AS (SELECT user_id, count(*) FILTER (n >= {FIRST} AND events > hi) AS a, count(*) FILTER (n >= {FIRST} AND value < lo) AS b, count(*) FILTER (n >= {FIRST} AND events > hi AND value < lo) AS c FROM wide JOIN ex USING (user_id) GROUP BY 1),
f AS (SELECT user_id, 'baseline_comparison' AS family, metric, unnest(['baseline_mean', 'window_mean', 'mean_difference']) AS name, unnest([b, w, w - b]) AS value FROM m
UNION ALL SELECT user_id, 'ordered_halves', metric, unnest(['first_mean', 'last_mean']), unnest([h1, h2]) FROM m
UNION ALL SELECT user_id, 'day_groups', metric, unnest(['weekday_mean', 'weekend_mean']), unnest([d, e]) FROM m
UNION ALL SELECT user_id, 'missing', metric, 'missing_days', gone FROM m WHERE gone > 0
UNION ALL SELECT user_id, 'sleep_timing', 'signup', unnest(['earliest', 'latest', 'range']), unnest([a, b, b - a]) FROM t
UNION ALL SELECT user_id, 'interval_structure', 'view', 'mean_longest_minutes', m FROM i
UNION ALL SELECT user_id, 'lag_alignment', 'value', unnest(['mean_after_evening', 'mean_after_other']), unnest([x, y]) FROM al WHERE seen
UNION ALL SELECT user_id, 'date_overlap', 'events', unnest(['days_above', 'days_below', 'days_both']), unnest([a, b, c]) FROM o)
SELECT user_id, family, metric, name, round(value::DOUBLE, 6) AS value FROM f""")
def raw_facts(spark, d):
    """Seven families of facts of each user's month, the first 16 days of it being the baseline."""
    n = F.datediff(F.to_date("start_at"), F.lit(START).cast("date")) + 1
    spans = _spans(spark, d).withColumn("n", n).withColumn("metric", F.col("event_type")).withColumn("minutes", cases.minutes())
    noon = F.pmod(F.hour("start_at") * 60 + F.minute("start_at") - 720, F.lit(1440))
    timed = spans.where("event_type = 'signup'").withColumn("minute", noon)
    evenings = spans.where((F.col("event_type") == "click") & (F.hour("start_at") >= 18) & (F.col("n") <= 30))
    weekend = F.weekday(F.date_add(F.lit(START).cast("date"), F.col("n") - 1)) >= 5
    out = views.facts(_long(spark, d), timed, spans.where("event_type = 'view'"), evenings, ["user_id"], FIRST, HALF, weekend, "value", "events", "value")
    return out.withColumn("value", r("value"))


# --- shares of cases ------------------------------------------------------------------------------------------------------

_CASES = """c AS (SELECT doc_id AS case_id, source, CASE WHEN doc_id % 3 = 0 THEN 'clear' ELSE 'unclear' END AS priority,
CASE doc_id % 4 WHEN 0 THEN 'unique_best' WHEN 1 THEN 'tied_best' WHEN 2 THEN 'none' ELSE 'insufficient_information' END AS top_outcome, doc_id % 5 AS i, doc_id % 7 AS p FROM documents)"""
_SHARES = """count(*) FILTER (priority = 'clear' AND top_outcome <> 'insufficient_information') / count(*) AS clear_share, count(*) FILTER (i < 2) AS multi_applicable,
count(*) FILTER (i < 2 AND priority = 'clear' AND top_outcome <> 'insufficient_information') / nullif(count(*) FILTER (i < 2), 0) AS multi_clear_share, count(*) FILTER (doc_id % 4 < 2) / count(*) AS decidable_share,
count(*) FILTER (i = 4 OR p = 6 OR doc_id % 4 = 3) / count(*) AS insufficient_share, count(*) FILTER (p = 0) / count(*) AS tie_share"""
_OUTCOMES = ("unique_best", "tied_best", "none", "insufficient_information")


def _cases(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("doc_id", "case_id")
    texts = lambda *labels: F.array(*[F.lit(x) for x in labels])
    k = F.col("case_id")
    items = F.when(k % 5 < 2, texts("applicable", "applicable", "not_applicable")).when(k % 5 == 4, texts("applicable", "insufficient_information")).otherwise(texts("applicable"))
    pairs = F.when(k % 7 == 0, texts("tie", "left")).when(k % 7 == 6, texts("insufficient_information")).otherwise(texts("left"))
    outcome = F.element_at(texts(*_OUTCOMES), (k % 4 + 1).cast("int"))
    return rows, rows.select("case_id", F.when(k % 3 == 0, "clear").otherwise("unclear").alias("priority"), outcome.alias("top_outcome"), items.alias("items"), pairs.alias("pairs"))


@query(f"WITH {_CASES} SELECT count(*) AS cases, 0 AS unresolved, {_SHARES.replace('doc_id', 'case_id')} FROM c")
def descriptive_shares(spark, d):
    return views.descriptive(*_cases(spark, d))


@query("""SELECT count(*) AS cases, count(*) FILTER (doc_id % 97 = 5) AS unresolved, NULL::DOUBLE AS clear_share, NULL::BIGINT AS multi_applicable, NULL::DOUBLE AS multi_clear_share, NULL::DOUBLE AS decidable_share,
NULL::DOUBLE AS insufficient_share, NULL::DOUBLE AS tie_share FROM documents""")
def descriptive_gate(spark, d):
    """Some cases are unresolved, so no share is given."""
    rows, resolved = _cases(spark, d)
    return views.descriptive(rows, resolved.where("case_id % 97 <> 5"))


@query(f"WITH {_CASES} SELECT source, priority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM c GROUP BY 1, 2")
def subject_breakdown(spark, d):
    return views.breakdown(*_cases(spark, d), "source", "priority").withColumn("share", r("share"))


@query("SELECT sha256('r1|' || doc_id) AS opaque_id, n_chars FROM documents ORDER BY 1")
def release_order(spark, d):
    return views.released(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "r1")


@query("SELECT event_type AS run, min(ts)::DATE::VARCHAR AS started, count(*) AS records, count(DISTINCT user_id) AS cases FROM events GROUP BY 1 ORDER BY started, run")
def run_inventory(spark, d):
    """One row per run with the allowed fields only, in order of their start."""
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(
        F.min("ts").cast("date").cast("string").alias("started"), F.count("*").alias("records"), F.count_distinct("user_id").alias("cases"), F.max("props").alias("private"))
    return records.allowed(runs, ["run", "started", "records", "cases"]).orderBy("started", "run")


# --- audits ---------------------------------------------------------------------------------------------------------------


@query("""SELECT 'duplicate' AS rule, doc_id || '|c0' AS key, '2' AS detail FROM documents WHERE doc_id % 11 = 1 UNION ALL SELECT 'missing', doc_id || '|c1', 'absent' FROM documents WHERE doc_id % 11 = 2
UNION ALL SELECT 'unexpected', doc_id || '|x', 'not expected' FROM documents WHERE doc_id % 11 = 3 UNION ALL SELECT 'text', doc_id || '|c0', 'changed' FROM documents WHERE doc_id % 11 = 4
UNION ALL SELECT 'role', doc_id || '|c0', 'other' FROM documents WHERE doc_id % 11 = 5 UNION ALL SELECT 'support', doc_id || '|c0', 'MAYBE' FROM documents WHERE doc_id % 11 = 6
UNION ALL SELECT 'evidence', doc_id || '|c0', 'none' FROM documents WHERE doc_id % 11 = 7 UNION ALL SELECT 'quote', doc_id || '|c0|0', 'not in paragraph' FROM documents WHERE doc_id % 11 IN (8, 9)""")
def source_audit(spark, d):
    """Two conditions of each document with a quote each; faults by the id's remainder by 11, of 10 an unverifiable one without any."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.concat(F.lit("Begin "), F.coalesce("text", F.lit(""))).alias("text"))
    k = F.col("source_id") % 11
    names = F.when(k == 1, F.array(F.lit("c0"), F.lit("c0"), F.lit("c1"))).when(k == 2, F.array(F.lit("c0"))).when(k == 3, F.array(F.lit("c0"), F.lit("c1"), F.lit("x"))).otherwise(F.array(F.lit("c0"), F.lit("c1")))
    rows = docs.select("source_id", "text", F.explode(names).alias("condition_id"))
    at = lambda n: (k == n) & (F.col("condition_id") == "c0")
    quote = F.struct(F.when(at(9), "p9").otherwise("p0").alias("paragraph_id"), F.when(at(8), "\u0001").otherwise(F.substring("text", 1, 40)).alias("quote"))
    checked = rows.select(
        "source_id", "condition_id", F.when(at(4), "changed").otherwise(F.concat(F.lit("condition "), "condition_id")).alias("original_text"), F.when(at(5), "other").otherwise("disputed").alias("role"),
        F.when(at(6), "MAYBE").when(at(10), "UNVERIFIABLE").otherwise("EXPLICIT_SUPPORT").alias("support"), F.when(~(at(7) | at(10)), F.array(quote)).otherwise(F.array().cast("array<struct<paragraph_id:string,quote:string>>")).alias("evidence"))
    expected = docs.select("source_id", F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("condition_id")).withColumn("text", F.concat(F.lit("condition "), "condition_id"))
    return audits.sources(checked, expected, docs.withColumn("paragraph_id", F.lit("p0")))


@query("""SELECT 'status' AS rule, conv_id::VARCHAR AS key, 'open' AS detail FROM x WHERE k = 1 UNION ALL SELECT 'attestation', conv_id::VARCHAR, 'absent' FROM x WHERE k IN (2, 3) UNION ALL SELECT 'reviewer', conv_id::VARCHAR, 'B' FROM x WHERE k = 4
UNION ALL SELECT 'release', conv_id::VARCHAR, 'r0' FROM x WHERE k = 5 UNION ALL SELECT 'zone', conv_id::VARCHAR, '2024-01-05T10:00:00' FROM x WHERE k = 6""".replace("FROM x", "FROM (SELECT DISTINCT conv_id, conv_id % 8 AS k FROM conversations)"))
def submission_audit(spark, d):
    k = F.col("conv_id") % 8
    rows = table(spark, d, "conversations").select("conv_id").distinct().select(
        "conv_id", F.when(k == 1, "open").otherwise("complete").alias("status"), F.when(k == 2, False).when(k != 3, True).alias("human_attestation"), F.when(k == 4, "B").otherwise("A").alias("reviewer_id"),
        F.when(k == 5, "r0").otherwise("r1").alias("release_id"), F.when(k == 6, "2024-01-05T10:00:00").when(k == 7, "2024-01-05T10:00:00Z").otherwise("2024-01-05T10:00:00+08:00").alias("completed_at"))
    return audits.submissions(rows, "conv_id", "A", "r1")


@query("""WITH x AS (SELECT doc_id, doc_id % 13 AS k, doc_id || '|K' AS key FROM documents) SELECT 'missing' AS rule, key, 'absent' AS detail FROM x WHERE k = 1 UNION ALL SELECT 'unexpected', doc_id || '|L', 'not expected' FROM x WHERE k = 1
UNION ALL SELECT 'label', key, 'maybe' FROM x WHERE k = 2 UNION ALL SELECT 'missing_information', key, 'not described' FROM x WHERE k IN (2, 8) UNION ALL SELECT 'topic', key, 'null' FROM x WHERE false UNION ALL SELECT 'topic', key, 'some' FROM x WHERE k = 3
UNION ALL SELECT 'rationale', key, 'empty' FROM x WHERE k = 4 UNION ALL SELECT 'citation', key, 'unknown condition' FROM x WHERE k IN (5, 6) UNION ALL SELECT 'observed', key, 'nothing cited' FROM x WHERE k = 7
UNION ALL SELECT 'judgments', key, 'incomplete' FROM x WHERE k IN (9, 10) UNION ALL SELECT 'evidence', key || '|d2', 'not observed' FROM x WHERE k = 11""")
def human_item_audit(spark, d):
    """One candidate of each document; faults by the id's remainder by 13."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"))
    k, texts = F.col("case_id") % 13, lambda *x: F.array(*[F.lit(t) for t in x]) if x else F.array().cast("array<string>")
    judged = lambda i, s, why: F.struct(F.lit(i).alias("condition_id"), F.lit(s).alias("status"), F.lit(why).alias("rationale"))
    good = F.array(judged("a.0", "satisfied", "seen"), judged("a.1", "unknown", "not said"))
    judgments = F.when(k == 9, F.array(judged("a.0", "satisfied", "seen"))).when(k == 10, F.array(judged("a.0", "satisfied", " "), judged("a.1", "unknown", "not said"))).otherwise(good)
    items = docs.select(
        "case_id", F.when(k == 1, "L").otherwise("K").alias("candidate"), F.when(k == 2, "maybe").when(k == 8, "insufficient_information").otherwise("applicable").alias("applicability"), F.when(k == 3, "some").otherwise("related").alias("topic"),
        F.when(k == 4, " ").otherwise("why").alias("rationale"), F.when(k == 5, texts()).when(k == 6, texts("a.0", "b.0")).otherwise(texts("a.1")).alias("conditions"),
        F.when(k == 7, texts()).when(k == 11, texts("d1", "d2")).otherwise(texts("d1")).alias("observations"), texts().alias("missing"), judgments.alias("judgments"))
    expected = docs.select("case_id", F.lit("K").alias("candidate"), texts("a.0", "a.1").alias("known"))
    return audits.judged_items(items, expected, docs.select("case_id", F.lit("d1").alias("ref")))


@query("""WITH x AS (SELECT doc_id, doc_id % 10 AS k, doc_id::VARCHAR AS key FROM labels) SELECT 'missing' AS rule, key, 'absent' AS detail FROM x WHERE k = 1 UNION ALL SELECT 'gold', key, '0 <> 1' FROM x WHERE k = 2
UNION ALL SELECT 'judge_a', key, 'null <> 1' FROM x WHERE k = 3 UNION ALL SELECT 'judge_b', key, '2 <> null' FROM x WHERE k = 4 UNION ALL SELECT 'agreed', key, 'true <> false' FROM x WHERE k = 5
UNION ALL SELECT 'changed', key, 'false <> true' FROM x WHERE k = 6 UNION ALL SELECT 'inputs', key, 'the same' FROM x WHERE k = 7""")
def annotation_audit(spark, d):
    """Labels of two judges, the final ones and gold; faults by the id's remainder by 10."""
    ids = table(spark, d, "labels").select("doc_id")
    k = F.col("doc_id") % 10
    judge = lambda label, name: ids.select("doc_id", label.alias("relevance"), F.lit("labeled").alias("status"), F.sha2(F.concat(F.when(k == 7, "same").otherwise(name), F.col("doc_id").cast("string")), 256).alias("input_sha256"))
    one = F.lit(1)
    a, b = judge(one, "a"), judge(F.when(k == 5, 2).when(k != 4, 1), "b")
    final = ids.select(
        "doc_id", F.when(k.isin(6, 8), 2).otherwise(1).alias("relevance"), F.when(k != 3, 1).alias("judge_a"), F.when(k.isin(4, 5), 2).otherwise(1).alias("judge_b"),
        (k != 4).alias("judges_agreed"), (k == 8).alias("changed_agreement"))
    gold = ids.where(k != 1).select("doc_id", F.when(k == 2, 0).when(k.isin(6, 8), 2).otherwise(1).alias("relevance"))
    return audits.annotations(a, b, final, gold, ["doc_id"])


@query("""WITH x AS (SELECT item_id, item_id % 9 AS k FROM benchmark) SELECT 'missing' AS rule, item_id || '|B1|1' AS key, 'absent' AS detail FROM x WHERE k = 1 UNION ALL SELECT 'status', item_id || '|B1|1', 'failed' FROM x WHERE k = 2
UNION ALL SELECT 'input', item_id || '|B1|1', 'changed' FROM x WHERE k = 3 UNION ALL SELECT 'text', item_id || '|B1|1', 'empty' FROM x WHERE k = 4 UNION ALL SELECT 'queries', item_id || '|B3|1', 'differ' FROM x WHERE k = 5
UNION ALL SELECT 'queries', item_id || '|B1|1', 'differ' FROM x WHERE k = 6 UNION ALL SELECT 'tokens', item_id || '|B1|1', '7' FROM x WHERE k = 7 UNION ALL SELECT 'budget', item_id || '|B1|1', '99' FROM x WHERE k = 8
UNION ALL SELECT 'facts', item_id || '|B4|1', 'not the facts' FROM x WHERE k = 0""")
def representation_audit(spark, d):
    """Three methods' texts of each item; faults by the id's remainder by 9."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.sha2("text", 256).alias("sha256"), F.concat(F.lit("facts "), F.col("item_id").cast("string")).alias("facts"))
    grid = items.select("*", F.explode(F.array(F.lit("B1"), F.lit("B3"), F.lit("B4"))).alias("method")).withColumn("repeat", F.lit(1))
    k = F.col("case_id") % 9
    at = lambda n, m="B1": (k == n) & (F.col("method") == m)
    parts, none = F.array(F.lit("one"), F.lit("two")), F.array().cast("array<string>")
    text = F.when(F.col("method") == "B4", F.when(k == 0, "else").otherwise(F.col("facts"))).when(at(4), " ").when(F.col("method") == "B3", F.when(k == 5, "one two").otherwise("one\ntwo")).otherwise("one")
    counted = F.when(at(8), 99).otherwise(2)
    rows = grid.where(~at(1)).select(
        "case_id", "method", "repeat", F.when(at(2), "failed").otherwise("completed").alias("status"), F.when(at(3), "0").otherwise(F.col("sha256")).alias("input_sha256"), text.alias("text"),
        F.when((F.col("method") == "B3") | at(6), parts).otherwise(none).alias("queries"), F.when(at(7), 7).otherwise(counted).alias("tokens"), counted.alias("counted"))
    return audits.representations(rows, grid.select("case_id", "method", "repeat"), items, 50, "B3", "B4")


@query("SELECT 'round' AS rule, conv_id::VARCHAR AS key, count(DISTINCT turn) || ' of 4' AS detail FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) <> 4")
def incomplete_rounds(spark, d):
    rows = table(spark, d, "conversations")
    return audits.rounds(rows, rows.select("conv_id").distinct().withColumn("expected", F.lit(4)), ["conv_id"], "turn")


@query(f"""WITH {_GRID}, c AS (SELECT user_id, n, metric, value, n % 7 AS k FROM long), f AS (SELECT *, user_id || '|' || n || '|' || metric AS key, value IS NULL OR (metric = 'clicks' AND value = 0) AS gone FROM c WHERE k <> 3)
SELECT 'observation' AS rule, user_id || '|' || (n + 100) || '|' || metric AS key, 'absent' AS detail FROM c WHERE k = 3 UNION ALL SELECT 'value', key, 'differs' FROM f WHERE k = 1 AND value IS NOT NULL
UNION ALL SELECT 'value', key, 'differs' FROM f WHERE k = 5 AND value IS NULL UNION ALL SELECT 'phase', key, 'other' FROM f WHERE k = 2 UNION ALL SELECT 'unusable', key, 'support' FROM f WHERE gone AND k <> 4""")
def claim_audit(spark, d):
    """Cited observations; faults by the day's remainder by 7: another value, phase or day, and values where there are none."""
    k = F.col("n") % 7
    value = F.when(k == 1, F.col("value") + 0.01).when(k == 5, F.coalesce("value", F.lit(1.0))).otherwise(F.col("value") + 0.0001)
    stated = _long(spark, d).select(
        "user_id", F.when(k == 3, F.col("n") + 100).otherwise(F.col("n")).alias("n"), "metric", value.alias("value"),
        F.when(k == 2, "other").when(F.col("n") <= BASELINE, "baseline").otherwise("current").alias("phase"), F.when(k == 4, "missingness").otherwise("support").alias("purpose"))
    return audits.claims(stated, _long(spark, d), ["user_id"], BASELINE, ("clicks",))


# --- checks that stand alone ----------------------------------------------------------------------------------------------


@query("""SELECT 'value' AS rule, doc_id::VARCHAR AS key, CASE doc_id % 8 WHEN 1 THEN '1.0 <> 1.5' WHEN 2 THEN '1.0 <> null' WHEN 3 THEN 'null <> 1.0' ELSE 'null <> 1.0' END AS detail FROM documents WHERE doc_id % 8 IN (1, 2, 3, 4)""")
def metric_differences(spark, d):
    """Saved metrics against computed ones: another value, a key on one side, a null on one side; tiny differences pass."""
    ids, k = table(spark, d, "documents").select("doc_id"), F.col("doc_id") % 8
    saved = ids.where(k != 3).withColumn("v", F.when(k == 5, 1.0 + 1e-12).when(k == 6, None).when(k != 4, 1.0))
    again = ids.where(k != 2).withColumn("v", F.when(k == 1, 1.5).when(k != 6, 1.0))
    return checks.same_values(saved, again, ["doc_id"], "v")


@query("""WITH x AS (SELECT doc_id, doc_id % 6 AS k FROM documents) SELECT 'labels' AS stage, rule, n AS violations FROM (SELECT 'low' AS rule, count(*) FILTER (k = 1) AS n FROM x UNION ALL SELECT 'high', count(*) FILTER (k = 2) FROM x)
UNION ALL SELECT 'texts', 'odd', count(*) FILTER (k % 2 = 1) FROM x""")
def stage_overview(spark, d):
    """All stages' violations by rule; a stage without any has no row."""
    x = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 6).alias("k"))
    rule = lambda name, bad: checks.holds(x, name, ["doc_id"], ~bad, F.lit(""))
    k = F.col("k")
    return cases.overview({"labels": rule("low", k == 1).unionByName(rule("high", k == 2)), "texts": rule("odd", k % 2 == 1), "clean": rule("none", k > 9)})


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'UNKNOWN_CONDITION' WHEN 2 THEN 'NO_CONDITION' WHEN 3 THEN 'NO_OBSERVATION' WHEN 4 THEN 'NO_MISSING_INFORMATION' WHEN 5 THEN 'UNKNOWN_LABEL' WHEN 6 THEN 'REPEATED_CITATION'
WHEN 7 THEN 'NO_CONDITION,NO_OBSERVATION' ELSE '' END AS codes FROM documents""")
def citation_codes(spark, d):
    k, texts = F.col("doc_id") % 8, lambda *x: F.array(*[F.lit(t) for t in x]) if x else F.array().cast("array<string>")
    observations = F.when(k.isin(3, 7), texts()).when(k == 6, texts("d1", "d1")).otherwise(texts("d1"))
    named = F.when(k == 1, texts("a", "z")).when(k.isin(2, 7), texts()).otherwise(texts("a"))
    label = F.when(k == 4, "insufficient_information").when(k == 5, "maybe").otherwise("applicable")
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", judging.citation_errors(texts("a", "b"), observations, named, label, texts())).alias("codes"))


_ROSTERS = """p AS (SELECT c_nationkey AS nation, ['A', 'B', 'C'][row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)] AS who, c_mktsegment AS person, c_acctbal AS b FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 3)"""


@query(f"""WITH {_ROSTERS} SELECT 'duplicate' AS rule, nation || '|' || person AS key, count(*)::VARCHAR AS detail FROM p GROUP BY nation, person HAVING count(*) > 1
UNION ALL SELECT 'human', nation || '|' || who, person FROM p WHERE b < 0 UNION ALL SELECT 'role', nation || '|C', person FROM p WHERE who = 'C' AND b < 3000 UNION ALL SELECT 'adjudicator', nation || '|C', person FROM p WHERE who = 'C' AND b < 5000
UNION ALL SELECT 'three', nation || '|all', count(*)::VARCHAR FROM p GROUP BY nation HAVING count(*) < 3 UNION ALL SELECT 'expertise', nation || '|all', '0' FROM p GROUP BY nation HAVING count(*) FILTER (who < 'C' AND b >= 5000) = 0""")
def roster_audit(spark, d):
    """A roster of each nation's first three customers: persons by segment, qualified by balance; debtors count as no humans."""
    from pyspark.sql import Window as W

    place, b = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")), F.col("c_acctbal")
    first = table(spark, d, "customer").withColumn("place", place).where("place <= 3")
    who = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("place"))
    people = first.select(
        F.col("c_nationkey").alias("nation"), who.alias("reviewer_id"), F.col("c_mktsegment").alias("person_id"), F.when((F.col("place") == 3) & (b >= 3000), "adjudicator").otherwise("reviewer").alias("role"), F.lit("some").alias("background"),
        (b >= 0).alias("is_human"), F.lit(True).alias("independent"), (b >= 5000).alias("qualified"))
    return values.roster_violations(people, ["nation"])


@query("""SELECT 'with' AS gold, source, round(avg(n_chars), 6) AS size, 'READY' AS status FROM documents GROUP BY 2 UNION ALL SELECT 'without', source, NULL, 'PENDING' FROM documents GROUP BY 2""")
def gold_gate(spark, d):
    metrics = table(spark, d, "documents").groupBy("source").agg(r(F.avg("n_chars")).alias("size"))
    gold = table(spark, d, "labels")
    parts = [judging.gated(metrics, g, ["size"]).withColumn("gold", F.lit(n)) for n, g in (("with", gold), ("without", gold.where("false")))]
    return parts[0].unionByName(parts[1])


@query("SELECT 'panel' AS rule, conv_id::VARCHAR AS key, string_agg(DISTINCT role, ',' ORDER BY role) AS detail FROM conversations GROUP BY conv_id HAVING string_agg(DISTINCT role, ',' ORDER BY role) IS DISTINCT FROM 'assistant,user'")
def panel_equality(spark, d):
    """Cases whose set of entries isn't the panel's."""
    sets = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("have"))
    told = F.when(F.size("have") > 0, F.concat_ws(",", "have"))
    return checks.holds(sets, "panel", ["conv_id"], F.col("have") == F.array(F.lit("assistant"), F.lit("user")), told)


@query("""SELECT 'item' AS rule, doc_id::VARCHAR AS key, source AS detail FROM documents WHERE doc_id % 5 <> 4 UNION ALL SELECT 'item', doc_id::VARCHAR, 'other' FROM documents WHERE doc_id % 5 = 4
UNION ALL SELECT 'union', doc_id::VARCHAR, 'differ' FROM documents WHERE doc_id % 5 = 3 AND source IS DISTINCT FROM 'other'""")
def item_union(spark, d):
    """Two panels' items by id: of the left side those with remainders 0 to 3 by 5, of the right 2 to 4; 3 and 4 are changed there."""
    docs, k = table(spark, d, "documents").select("doc_id", "source"), F.col("doc_id") % 5
    changed = docs.where(k >= 2).withColumn("source", F.when(k >= 3, "other").otherwise(F.col("source")))
    items, bad = audits.united(docs.where(k <= 3), changed, "doc_id", ["source"])
    return items.select(F.lit("item").alias("rule"), F.col("doc_id").cast("string").alias("key"), F.col("source").alias("detail")).unionByName(bad)


@query("SELECT event_id, event_id % 3 <> 1 AS same FROM events")
def fieldless_equality(spark, d):
    """Records that are equal without one field: its change doesn't count, another's does."""
    k = F.col("event_id") % 3
    row = lambda own, other: F.struct(F.col("value"), own.alias("kept"), other.alias("dropped"))
    both = table(spark, d, "events").select("event_id", row(F.lit(1), F.lit(1)).alias("a"), row(F.when(k == 1, 2).otherwise(1), F.when(k == 2, 2).otherwise(1)).alias("b"))
    both = records.without_fields(records.without_fields(both, "a", ["dropped"]), "b", ["dropped"])
    return both.select("event_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ',x' END AS entries FROM events")
def array_values(spark, d):
    k = F.col("event_id") % 3
    document = F.when(k == 0, F.concat(F.lit('["'), "event_type", F.lit('", "x"]'))).when(k == 1, '{"a": 1}').otherwise("[broken")
    found = records.decoded_array(document)
    return table(spark, d, "events").select("event_id", F.when(found.isNotNull(), F.concat_ws(",", found)).alias("entries"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def selected_cases(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")
