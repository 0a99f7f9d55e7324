"""Queries that go through files and back: readers and writers, imports of exports, stored results, logs and inventories, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as words
from tideline.operators import cases
from tideline.plans.queries import r
from tideline.plans.record_queries import query
from tideline.plans.run_queries import _CASES, _recipes
from tideline.sources import corpus, files, generator
from tideline.sources import records as imports
from tideline.sources.files import table
from tideline.sources.shared import filesystem, scratch


@query("SELECT doc_id, md5(text) AS digest, CASE WHEN lang <> 'en' THEN lang END AS lang, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    """Documents as lines of JSON and back; nulls stay."""
    path = scratch(spark, "jsonl")
    files.write_jsonl(table(spark, d, "documents").select("doc_id", "text", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), "n_chars"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string, n_chars long").select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("""SELECT c_custkey, c_name, '["' || c_nationkey || '","' || c_mktsegment || '"]' AS tags, round(c_acctbal, 6) AS balance FROM customer""")
def csv_round_trip(spark, d):
    """Customers as CSV with a nested cell, read back by their exact headings."""
    path = scratch(spark, "csv")
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", F.array(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("tags"), "c_acctbal"), path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, tags string, c_acctbal double").select("c_custkey", "c_name", "tags", r("c_acctbal").alias("balance"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def lenient_csv(spark, d):
    """The same without a schema: every cell is a text."""
    path = scratch(spark, "csv")
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return files.read_csv(spark, path, "", strict=False)


@query("SELECT lang, source, n, n_chars FROM (SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL)")
def json_document(spark, d):
    """A small summary as one JSON document, read back field by field."""
    rows = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    path = f"{scratch(spark, 'json')}/summary.json"
    files.write_json(spark, path, {"by_source": [x.asDict() for x in rows.collect()]})  # a row per source: a document that one machine writes
    return files.read_json(spark, path, "by_source array<struct<lang: string, source: string, n: long, n_chars: long>>").select(F.inline("by_source"))


@query("""WITH m AS (SELECT lang, '| ' || lang || ' | ' || count(*) || ' | ' || printf('%.3f', avg(n_chars)) || ' |' AS line FROM documents GROUP BY lang)
SELECT 0 AS n, '| lang | documents | mean |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT (row_number() OVER (ORDER BY lang) + 1)::INTEGER, line FROM m""")
def markdown_table(spark, d):
    """A report table of the documents by language, as lines."""
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.avg("n_chars").alias("mean")).orderBy("lang")
    return spark.createDataFrame(list(enumerate(files.markdown(rows).split("\n"))), "n int, line string")


@query("SELECT ts::DATE::VARCHAR AS day, least(round(sum(value), 6), 1440) AS value FROM events GROUP BY 1")
def imported_days(spark, d):
    """An export of daily values, some as numbers and some as objects, in which each day occurs once."""
    total = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.least(r(F.sum("value")), F.lit(1440.0)).alias("v"))
    raw = total.select(F.concat(F.col("day").cast("string"), F.lit("T00:00:00")).alias("dateTime"), F.when(F.dayofmonth("day") % 2 == 0, F.col("v").cast("string")).otherwise(F.to_json(F.struct(F.col("v").cast("string").alias("value")))).alias("value"))
    return imports.daily_metric(raw).select(F.col("day").cast("string").alias("day"), r("value").alias("value"))


@query("""WITH m AS (SELECT o_orderdate::DATE AS day, o_orderkey % 600 AS minutes, o_custkey % 5 AS late FROM orders WHERE o_orderpriority LIKE '1%'),
g AS (SELECT day, count(*) AS n, count(DISTINCT minutes || '|' || late) AS k, min(minutes) AS minutes, min(late) AS late FROM m GROUP BY day)
SELECT day::VARCHAR AS day, CASE WHEN n = 1 THEN minutes::DOUBLE END AS sleep_minutes, CASE WHEN n = 1 THEN CASE WHEN late < 2 THEN -1 ELSE 0 END END::INTEGER AS start_day_offset, CASE WHEN n > 1 THEN 'conflict' END AS flag FROM g""")
def imported_sleep(spark, d):
    """Sleep logs, urgent orders standing for main sleeps: a day with several has none, and a start before midnight is of the day before."""
    o, day = table(spark, d, "orders"), F.to_date("o_orderdate")
    start = F.when(F.col("o_custkey") % 5 < 2, F.date_sub(day, 1).cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")).otherwise(day.cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR"))
    logs = o.select(
        F.col("o_orderkey").alias("logId"), day.cast("string").alias("dateOfSleep"), start.cast("string").alias("startTime"), (day.cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS")).cast("string").alias("endTime"), F.startswith("o_orderpriority", F.lit("1")).alias("mainSleep"),
        (F.col("o_orderkey") % 600).alias("minutesAsleep"), F.lit(700).alias("timeInBed"), F.lit("stages").alias("type"), F.lit(0).alias("infoCode"))
    return imports.main_sleep(logs).select(F.col("day").cast("string").alias("day"), "sleep_minutes", "start_day_offset", "flag")


@query("SELECT doc_id, quality AS relevance FROM labels")
def stored_gold(spark, d):
    """Labels of a full matrix of expected documents, checked as they are read."""
    rows = table(spark, d, "labels").select("doc_id", "quality", F.lit("stored").alias("label_kind"))
    return imports.gold(rows, rows.select("doc_id"), ["doc_id"], "quality", "stored")


@query("SELECT lang, count(*) AS n, 1 AS made FROM documents GROUP BY 1")
def stored_once(spark, d):
    """A stored result: the second call reads what the first one made; a result without its mark is made anew."""
    path, docs = scratch(spark, "stored"), table(spark, d, "documents")
    counted = docs.groupBy("lang").agg(F.count("*").alias("n"))
    imports.stored(spark, path, lambda: counted.where("false").withColumn("made", F.lit(0)))
    filesystem(spark, path)[0].delete(filesystem(spark, f"{path}/_SUCCESS")[1], False)  # as if it had been stopped
    imports.stored(spark, path, lambda: counted.withColumn("made", F.lit(1)))
    return imports.stored(spark, path, lambda: counted.withColumn("made", F.lit(2)))


@query("SELECT c_mktsegment AS segment, count(*) AS customers, sum(c_nationkey)::BIGINT AS nations FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1")
def scanned_logs(spark, d):
    """Logs of calls, one document a folder at any depth; those of an archive are left out."""
    path = scratch(spark, "logs")
    own = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.sum("c_nationkey").alias("nations"))
    for x in own.collect():  # a folder per segment
        files.write_json(spark, f"{path}/{'Archived' if x[0] == 'FURNITURE' else 'run'}/{x[0]}/calls/metadata.json", {"segment": x[0], "customers": x[1], "nations": x[2]})
    return files.scan_logs(spark, path, "segment string, customers long, nations long").drop("path")


@query("""SELECT CASE WHEN c.nation IS NULL THEN 'missing' ELSE 'unexpected' END AS rule, coalesce(c.nation, s.nation)::VARCHAR AS key FROM (SELECT DISTINCT c_nationkey AS nation FROM customer) c
FULL JOIN (SELECT DISTINCT s_nationkey AS nation FROM supplier) s USING (nation) WHERE c.nation IS NULL OR s.nation IS NULL""")
def folder_inventory(spark, d):
    """A file for each nation with customers, where those with suppliers are expected."""
    path = scratch(spark, "folder")
    there = table(spark, d, "customer").select("c_nationkey").distinct()
    for (nation,) in there.collect():  # 25 nations at most
        files.write_json(spark, f"{path}/{nation}.json", {"nation": nation})
    expected = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("name")).distinct()
    return imports.inventory(spark, path, expected).select("rule", "key")


_KEY = b"tideline"
_PADS = ["".join(f"\\x{b ^ x:02X}" for b in _KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(f"SELECT doc_id, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(source || '/' || doc_id)))) AS opaque FROM documents")
def opaque_ids(spark, d):
    """Pseudonyms that only the key's owner can make."""
    return table(spark, d, "documents").select("doc_id", words.hmac_sha256(_KEY, F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("opaque"))


@query(f"""WITH {_CASES}, b AS (SELECT c_custkey AS "case", c_acctbal AS bal, c_mktsegment AS seg FROM customer)
SELECT rule, "case" || '|' || (DATE '2026-03-02' + n) AS key FROM d JOIN b USING ("case"), (VALUES ('finite'), ('wear'), ('reasons')) r(rule)
WHERE (rule = 'finite' AND n = 5 AND bal < 0) OR (rule = 'wear' AND n = 10 AND seg = 'BUILDING') OR (rule = 'reasons' AND n = 36 AND recipe = 8 AND bal > 5000)""")
def case_violations(spark, d):
    """The generated cases against the rules of daily metrics: debtors have a value that isn't finite, builders too little wear, and
    rich ones lack the reasons for what is missing."""
    facts = ("c_acctbal", "c_mktsegment")
    days = generator.generated_cases(_recipes(spark, d, *facts), facts=facts)
    reasons = F.when((F.col("n") == 36) & (F.col("c_acctbal") > 5000), F.array().cast("array<string>")).otherwise(F.transform("missing", lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), m)))
    at = lambda minute: F.timestamp_add("MINUTE", F.col(minute), F.col("day").cast("timestamp_ntz"))
    daily = days.select(
        "case", "day", *[F.col(m).cast("double").alias(n) if m != "rhr" else F.when((F.col("n") == 5) & (F.col("c_acctbal") < 0), float("nan")).otherwise(F.col(m).cast("double")).alias(n) for m, n in _NAMES.items()],
        F.when((F.col("n") == 10) & (F.col("c_mktsegment") == "BUILDING"), 100).otherwise(F.col("wear")).alias("wear"), F.col("coverage").alias("night_coverage"),
        F.map_from_arrays(reasons, F.transform(reasons, lambda m: F.lit("insufficient_coverage"))).alias("missing"))
    sleeps = days.select("case", "day", at("sleep_start").alias("start_at"), at("wake").alias("end_at"))
    return cases.metric_violations(daily, sleeps).select("rule", "key")


#: The generator's metrics as the rules name them.
_NAMES = dict(zip(("steps", "activity", "low"), cases.DAY_METRICS, strict=False)) | {"sleep": "sleep_duration_minutes", "rhr": "resting_heart_rate_bpm", "hrv": "hrv_rmssd_ms"}


# --- a corpus from seeds and sources --------------------------------------------------------------------------------------

_SEEDS = """f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY 1), o AS (SELECT f.source AS source_key, d.text, d.n_chars, CASE WHEN d.n_chars >= 400 THEN 'fetched' ELSE 'unavailable' END AS status FROM f JOIN documents d ON d.doc_id = f.first),
s AS (SELECT d.doc_id AS place, d.source AS source_key, d.lang AS domain, string_split(d.text, ' ') AS w, md5(d.text) AS content FROM documents d),
n AS (SELECT *, array_to_string(w[1:2], ' ') AS a1, array_to_string(w[3:3], ' ') AS a2, 'title ' || coalesce(w[1], '') AS title FROM s),
b AS (SELECT n.*, o.status, o.text AS whole, contains(nt, {a1}) AS h1, contains(nt, {a2}) AS h2 FROM n JOIN (SELECT *, {text} AS nt FROM o) o USING (source_key))"""


def _normal(c: str) -> str:
    return rf"trim(replace(lower(regexp_replace({c}, '\s+', ' ', 'g')), 'ß', 'ss'))"


_BORNE = _SEEDS.format(a1=_normal("a1"), a2=_normal("a2"), text=_normal("text"))


def _corpus(spark, d):
    """Each document as a seed, whose anchors its source's first document must hold."""
    docs = table(spark, d, "documents")
    w = F.split("text", " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    seeds = docs.select(F.col("doc_id").alias("place"), F.col("source").alias("source_key"), F.col("lang").alias("domain"), F.concat(F.lit("title "), part(1, 1)).alias("title"), F.md5("text").alias("content"), F.array(part(1, 2), part(3, 1)).alias("anchors"))
    first = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")).join(docs.select("doc_id", "text", "n_chars"), "doc_id")
    sources = first.select(F.col("source").alias("source_key"), F.when(F.col("n_chars") >= 400, corpus.FETCHED).otherwise("unavailable").alias("status"), F.concat(F.lit("https://"), "source").alias("source_url"), F.upper("source").alias("publisher"), "text")
    return seeds, sources


@query(f"""WITH {_BORNE}, q AS (SELECT lang AS domain, count(*) FILTER (n_chars > 200) AS n, count(*) AS found FROM documents GROUP BY 1), t AS (SELECT min(place) AS place, count(*) AS n FROM b GROUP BY {_normal("title || content")})
SELECT 'source' AS rule, place::VARCHAR AS key FROM b WHERE status <> 'fetched' UNION ALL SELECT 'anchor', place::VARCHAR FROM b WHERE status = 'fetched' AND NOT (h1 AND h2)
UNION ALL SELECT 'duplicate', place::VARCHAR FROM t WHERE n > 1 UNION ALL SELECT 'quota', domain FROM q WHERE n <> found""")
def corpus_violations(spark, d):
    seeds, sources = _corpus(spark, d)
    quotas = table(spark, d, "documents").where("n_chars > 200").groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("n"))
    return corpus.violations(seeds, sources, quotas).select("rule", "key")


@query(f"""WITH {_BORNE}, i AS (SELECT printf('K%03d', row_number() OVER (ORDER BY place)) AS id, * FROM b)
SELECT id, domain, title, upper(source_key) AS source, 'text anchors: ' || a1 || ' | ' || a2 AS source_locator,
sha256('{{"content":"' || content || '","domain":' || to_json(domain) || ',"id":"' || id || '","source":' || to_json(upper(source_key)) || ',"source_locator":' || to_json('text anchors: ' || a1 || ' | ' || a2) || ',"source_url":' || to_json('https://' || source_key) || ',"status":"verified","title":' || to_json(title) || '}}') AS item_sha256
FROM i WHERE status = 'fetched' AND h1 AND h2""")
def corpus_items(spark, d):
    """The items that their sources bear out, numbered as the seeds are, with digests of their records."""
    return corpus.items(*_corpus(spark, d)).select("id", "domain", "title", "source", "source_locator", "item_sha256")


@query(f"""WITH {_BORNE}, e AS (SELECT place, whole, unnest([a1, a2]) AS anchor, unnest([h1, h2]) AS h FROM b WHERE status = 'fetched'), x AS (SELECT place, anchor, regexp_replace(whole, '\\s+', ' ', 'g') AS t FROM e WHERE h)
SELECT place, anchor, md5(substr(t, greatest(1, instr(t, anchor) - 700), instr(t, anchor) - greatest(1, instr(t, anchor) - 700) + 1900)) AS digest FROM x WHERE instr(t, anchor) > 0""")
def review_contexts(spark, d):
    found = corpus.review_contexts(*_corpus(spark, d))
    return found.where("context IS NOT NULL").select("place", "anchor", F.md5("context").alias("digest"))
