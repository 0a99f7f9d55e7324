"""Queries of strict values, prepared queries, links, and plain selections, counts and set operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import records, runs, values
from tideline.plans import oracles as base
from tideline.plans.queries import r
from tideline.plans.record_queries import query
from tideline.sources.files import spread, table

# --- strict values --------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS utc FROM events")
def zoned_timestamps(spark, d):
    """Only the offset that the rules name is read; every third text states another."""
    stated = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 < 2, values.OFFSET).otherwise("+07:00"))
    return table(spark, d, "events").select("event_id", F.date_format(values.timestamp_at(stated), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("SELECT event_id, strftime(ts::DATE + to_seconds(event_id % 1440 * 60 + 30), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def day_instants(spark, d):
    at = values.instant(F.to_date("ts"), F.col("event_id") % 1440 + 0.5)
    return table(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT event_id, array_to_string(list_transform([0, 1, 2], lambda k: event_id % 100 // 3 + (k < event_id % 100 % 3)::INTEGER), ',') AS parts FROM events")
def near_equal_parts(spark, d):
    return table(spark, d, "events").select("event_id", F.concat_ws(",", values.parts(F.col("event_id") % 100, 3).cast("array<string>")).alias("parts"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true ELSE false END AS valid FROM documents")
def hash_shapes(spark, d):
    k, own = F.col("doc_id") % 4, F.sha2("text", 256)
    shape = F.when(k == 0, own).when(k == 1, F.concat(own, F.lit("\n"))).when(k == 2, F.overlay(own, F.lit("A"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", values.is_hash(shape).alias("valid"))


_LABELS = "x AS (SELECT event_id, ['0', '2', '3', '', 'x'][event_id % 5 + 1] AS v, ['labeled', 'needs_review', 'other'][event_id % 3 + 1] AS s FROM events)"


@query(f"""WITH {_LABELS} SELECT event_id, CASE WHEN v IN ('0', '1', '2') THEN v::INTEGER END AS grade,
CASE WHEN v IN ('3', 'x') THEN 'invalid label' WHEN s = 'labeled' AND v <> '' THEN 'ok' WHEN s = 'needs_review' AND v = '' THEN 'ok' ELSE 'unresolved' END AS status FROM x""")
def strict_labels(spark, d):
    pick = lambda options, n: F.element_at(F.array(*[F.lit(o) for o in options]), (F.col("event_id") % n + 1).cast("int"))
    label, status = pick(["0", "2", "3", "", "x"], 5), pick(["labeled", "needs_review", "other"], 3)
    return table(spark, d, "events").select("event_id", values.grade(label).alias("grade"), values.grade_status(label, status, True).alias("status"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events")
def strict_booleans(spark, d):
    k = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", values.boolean(F.when(k == 0, "True").when(k == 1, "false").when(k == 2, "1").otherwise("TRUE")).alias("flag"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 AND value BETWEEN 0 AND 100 THEN round(value, 6) END AS number FROM events")
def bounded_numbers(spark, d):
    """Numbers from 0 to 100; true, quoted numbers, negative ones and broken texts are none."""
    k, v = F.col("event_id") % 5, F.col("value").cast("string")
    document = F.when(k == 0, v).when(k == 1, "true").when(k == 2, F.concat(F.lit('"'), v, F.lit('"'))).when(k == 3, "-1").otherwise("{")
    return table(spark, d, "events").select("event_id", r(values.bounded_number(document, 100)).alias("number"))


@query("""SELECT event_id, '$.n' AS path, 'value' AS fault FROM events WHERE event_id % 6 IN (2, 4) UNION ALL SELECT event_id, '$.l', 'length' FROM events WHERE event_id % 6 = 3
UNION ALL SELECT event_id, '$.o', 'fields' FROM events WHERE event_id % 6 = 5""")
def document_differences(spark, d):
    """Stored documents against computed ones: a small difference passes, true is no number, lists and objects need their shape."""
    k = F.col("event_id") % 6
    number = F.when(k == 1, "1.00000000001").when(k == 2, "1.1").when(k == 4, "true").otherwise("1.0")
    document = lambda n, items, fields: F.concat(F.lit('{"n": '), n, F.lit(', "l": ['), items, F.lit('], "o": {'), fields, F.lit("}}"))
    actual = document(number, F.when(k == 3, "1, 2, 3").otherwise("1, 2"), F.when(k == 5, '"b": 1').otherwise('"a": 1'))
    rows = spread(table(spark, d, "events").select("event_id")).select("event_id", actual.alias("actual"), document(F.lit("1.0"), F.lit("1, 2"), F.lit('"a": 1')).alias("expected"))
    return values.compared(rows, ["event_id"], "actual", "expected")


@query("""WITH c AS (SELECT conv_id, sum(coalesce(octet_length(encode(text)), 0) + 128)::BIGINT + 256 AS n FROM conversations GROUP BY 1)
SELECT conv_id, n AS input_ceiling, n <= 30720 AND n + 31000 <= 32768 AS fits, CASE WHEN n <= 30720 AND n + 31000 <= 32768 THEN round((n * 2.4 + 31000 * 9.6) / 1e6, 9) END AS reserved FROM c""")
def request_ceilings(spark, d):
    """What doesn't fit into the window is refused, not cut."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("m"))
    out = rows.select("conv_id", values.ceiling(F.col("m"), F.lit(31000)).alias("c")).select("conv_id", "c.*")
    return out.withColumn("reserved", r("reserved", 9))


# --- prepared queries and links -------------------------------------------------------------------------------------------

_SLOTS = "s AS (SELECT doc_id, doc_id % 2 = 0 AS parts, CASE WHEN doc_id % 2 = 0 THEN split(text, ' ')[1:CASE WHEN doc_id % 10 = 0 THEN 4 ELSE 5 END] WHEN trim(text) <> '' THEN [text] ELSE [] END AS t FROM documents)"


def _prepared(spark, d):
    parts = F.slice(F.split("text", " "), F.lit(1), F.when(F.col("doc_id") % 10 == 0, 4).otherwise(5))
    return runs.queries(table(spark, d, "documents").withColumn("slots", parts), "doc_id", F.col("doc_id") % 2 == 0, "slots", "text")


@query(f"WITH {_SLOTS} SELECT doc_id, k AS slot, md5(t[k + 1]) AS digest FROM (SELECT doc_id, t, unnest(range(len(t)))::INTEGER AS k FROM s)")
def prepared_queries(spark, d):
    """Five slots of every second document, the whole text of the others."""
    return _prepared(spark, d)[0].select("doc_id", "slot", F.md5("text").alias("digest"))


@query(f"WITH {_SLOTS} SELECT 'slots' AS rule, doc_id::VARCHAR AS key, len(t)::VARCHAR AS detail FROM s WHERE parts AND (len(t) <> 5 OR len(list_filter(t, lambda x: trim(x) = '')) > 0)")
def slot_violations(spark, d):
    return _prepared(spark, d)[1]


@query(f"""WITH f AS (SELECT item_id, ' ' || array_to_string({base._tok('text')}[4:5], ' ') || ' ' AS phrase FROM benchmark), i AS (SELECT doc_id, ' ' || array_to_string({base._tok('text')}, ' ') || ' ' AS whole FROM documents)
SELECT item_id, doc_id FROM f JOIN i ON contains(whole, phrase) WHERE trim(phrase) <> ''""")
def lexical_links(spark, d):
    """Facts, each with two words of a benchmark item as its alias, and the documents that have the alias as whole words."""
    from tideline.functions import text

    facts = table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", F.slice(text.tokens("text"), 4, 2)).alias("alias"))
    return runs.links(facts, table(spark, d, "documents"), "item_id", "alias", "doc_id", "text")


# --- plain rows -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-10'")
def period_series(spark, d):
    return table(spark, d, "events").where("ts >= TIMESTAMP'2024-01-05' AND ts < TIMESTAMP'2024-01-10'").select("event_id", "value")


@query("SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND trim(text) <> ''")
def verified_corpus(spark, d):
    kept = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").where("trim(text) <> ''").join(kept, "doc_id").select("doc_id", "source")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn DESC) FILTER (role <> 'system') AS roles FROM conversations GROUP BY 1")
def reversed_round(spark, d):
    """A second round in reverse order, without one kind of entry."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = F.transform(F.reverse(F.filter("t", lambda x: x.role != "system")), lambda x: x.role)
    return rows.select("conv_id", F.when(F.size(roles) > 0, F.concat_ws(",", roles)).alias("roles"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM c GROUP BY 1")
def category_histogram(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    found = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("c"))
    return found.select("user_id", F.concat_ws(",", F.transform("c", lambda x: F.concat_ws("=", x.event_type, x.n.cast("string")))).alias("counts"))


@query("SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN n_chars < 40 THEN 'short' END, CASE WHEN lang = 'en' THEN 'english' END]) AS flag FROM documents) WHERE flag IS NOT NULL GROUP BY 1")
def flag_tallies(spark, d):
    flags = records.flags(short=F.col("n_chars") < 40, english=F.col("lang") == "en")
    return table(spark, d, "documents").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS probes, count(*) FILTER (contains(lower(text), 'license') AND contains(lower(text), 'version')) AS candidates FROM documents GROUP BY 1")
def probe_totals(spark, d):
    hit = F.contains(F.lower("text"), F.lit("license")) & F.contains(F.lower("text"), F.lit("version"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("probes"), F.count_if(hit).alias("candidates"))


@query("SELECT conv_id, count(*) AS calls, count(*) FILTER (trim(text) <> '') AS parsed, sum(octet_length(encode(text)))::BIGINT AS bytes, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1")
def run_metadata(spark, d):
    out = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("calls"), F.count_if(F.trim("text") != "").alias("parsed"), F.sum(F.octet_length("text")).alias("bytes"), F.array_sort(F.collect_set("role")).alias("roles"))
    return out.withColumn("roles", F.when(F.size("roles") > 0, F.concat_ws(",", "roles")))


@query("SELECT event_id, isodow(ts)::INTEGER - 1 AS weekday, isodow(ts)::INTEGER AS isoweekday, round(hour(ts) * 60 + minute(ts) + second(ts) / 60.0, 6) AS clock FROM events")
def clock_parts(spark, d):
    part = F.split(F.date_format("ts", "HH:mm:ss"), ":").cast("array<double>")
    return table(spark, d, "events").select("event_id", F.weekday("ts").alias("weekday"), (F.weekday("ts") + 1).alias("isoweekday"), r(part[0] * 60 + part[1] + part[2] / 60).alias("clock"))


@query("SELECT event_id, round(ln(1 + abs(value)), 6) AS a, round(log2(1 + abs(value)), 6) AS b, round(sqrt(abs(value)), 6) AS c, round(atan2(sin(value), cos(value)), 6) AS d, greatest(0, least(50, value)) AS e FROM events")
def arithmetic(spark, d):
    v, size = F.col("value"), F.abs("value")
    e = table(spark, d, "events")
    return e.select("event_id", r(F.log(1 + size)).alias("a"), r(F.log2(1 + size)).alias("b"), r(F.sqrt(size)).alias("c"), r(F.atan2(F.sin(v), F.cos(v))).alias("d"), F.greatest(F.lit(0.0), F.least(F.lit(50.0), v)).alias("e"))


@query("SELECT user_id, ts::DATE::VARCHAR AS day FROM events WHERE event_type = 'click' INTERSECT SELECT user_id, ts::DATE::VARCHAR FROM events WHERE event_type = 'error'")
def overlapping_dates(spark, d):
    days = lambda kind: table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", F.to_date("ts").cast("string").alias("day"))
    return days("click").intersect(days("error"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('error', 'signup')")
def panel_union(spark, d):
    """Members of overlapping panels, each once."""
    groups = table(spark, d, "events").groupBy("event_type").agg(F.collect_set("user_id").alias("members"))
    return groups.where("event_type IN ('error', 'signup')").select(F.explode("members").alias("user_id")).distinct()


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 7")
def first_cases(spark, d):
    """A report of the first few by a stated order."""
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(7)


@query("SELECT 'K' || lpad(n_nationkey::VARCHAR, 3, '0') AS id, n_name FROM nation")
def positional_seeds(spark, d):
    """Items named by their seed's place meet the seed by the number in the name."""
    seeds = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("place"), "n_name")
    items = seeds.select(F.concat(F.lit("K"), F.lpad(F.col("place").cast("string"), 3, "0")).alias("id"))
    return items.withColumn("place", F.substring("id", 2, 9).cast("int")).join(seeds, "place").select("id", "n_name")
