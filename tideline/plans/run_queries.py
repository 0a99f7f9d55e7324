"""Queries of runs that keep state: budgets, resumable batches, full rankings, releases and frozen panels, with their SQL."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from tideline.functions import canonical
from tideline.functions import text as words
from tideline.operators import aliases, batches, evaluation, ledger, packing, panels, retrieval, runs, snapshots
from tideline.plans import oracles as base
from tideline.plans.queries import gold, grade_counts, passages, r, relevance
from tideline.plans.record_queries import query
from tideline.sources import generator, release
from tideline.sources.files import table
from tideline.sources.shared import filesystem, scratch

# --- budgets --------------------------------------------------------------------------------------------------------------

CAP, CALLS = 60_000, 90
_REQUESTS = "q AS (SELECT role, conv_id, turn, md5(text) AS request, (octet_length(encode(text)) + 128)::BIGINT AS cost, CASE WHEN md5(text) < '8' THEN (octet_length(encode(text)) + 128) // 2 END::BIGINT AS charged FROM conversations)"
_RESERVED = f"""WITH RECURSIVE {_REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, request, cost) AS k FROM q),
f AS (SELECT role, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, 0::BIGINT AS k, NULL::VARCHAR AS status, NULL::BIGINT AS attempt, 0::BIGINT AS used, []::VARCHAR[] AS seen FROM (SELECT DISTINCT role FROM q)
  UNION ALL SELECT role, conv_id, turn, k, status, CASE status WHEN 'cached' THEN list_position(seen, request) - 1 WHEN 'reserved' THEN len(seen) END,
    used + CASE WHEN status = 'reserved' THEN coalesce(charged, cost) ELSE 0 END, CASE WHEN status = 'reserved' THEN list_append(seen, request) ELSE seen END
  FROM (SELECT n.*, f.used, f.seen, CASE WHEN list_contains(f.seen, n.request) THEN 'cached' WHEN len(f.seen) < {CALLS} AND f.used + n.cost <= {CAP} THEN 'reserved' ELSE 'refused' END AS status
    FROM f JOIN n ON n.role = f.role AND n.k = f.k + 1))
SELECT role, conv_id, turn, status, attempt, used FROM f WHERE k > 0"""


def _requests(spark, d):
    cost = (F.octet_length("text") + 128).cast("long")
    rows = table(spark, d, "conversations").select("role", "conv_id", "turn", F.md5("text").alias("request"), cost.alias("cost"))
    return rows.withColumn("charged", F.when(F.col("request") < "8", F.expr("cost div 2")))


@query(_RESERVED)
def budget_reservations(spark, d):
    """Every turn as a request against the budget of its role."""
    out = ledger.reservations(_requests(spark, d), "role", ["conv_id", "turn"], "request", "cost", "charged", CAP, CALLS)
    return out.select("role", "conv_id", "turn", "status", "attempt", "used")


@query(_RESERVED)
def budget_reservations_stream(spark, d):
    """The same from a stream of requests that arrive in three parts."""
    asked, path = _requests(spark, d), scratch(spark, "requests")
    bounds = asked.agg(F.expr("percentile_disc(1/3D) WITHIN GROUP (ORDER BY conv_id)"), F.expr("percentile_disc(2/3D) WITHIN GROUP (ORDER BY conv_id)")).first()
    part = F.when(F.col("conv_id") <= bounds[0], 0).when(F.col("conv_id") <= bounds[1], 1).otherwise(2)
    for k in range(3):  # one after the other: files arrive in this order
        asked.where(part == k).coalesce(1).write.mode("append").parquet(path)
    out, state = scratch(spark, "reserved"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(state)
    spark.conf.set(state, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(path)
        done = ledger.reserved_stream(stream, "role", ["conv_id", "turn"], "request", "cost", "charged", CAP, CALLS)
        done.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(state, before)
    return spark.read.parquet(out).select("role", "conv_id", "turn", "status", "attempt", "used")


# --- batches --------------------------------------------------------------------------------------------------------------

LONG = 9000


@query(f"""WITH b AS (SELECT doc_id, text, (row_number() OVER (ORDER BY md5('batches|' || doc_id), doc_id) - 1) // 4 AS batch FROM documents),
f AS (SELECT batch, max(length(text)) > {LONG} AS failed FROM b GROUP BY batch)
SELECT doc_id, batch, md5(text || '!') AS digest, CASE WHEN regexp_matches(text, '\\S') THEN 'completed' ELSE 'empty_output' END AS status, CASE WHEN failed THEN 2 ELSE 1 END AS attempt FROM b JOIN f USING (batch)""")
def resumed_batches(spark, d):
    """A run whose calls refuse long texts is stopped after a micro-batch and started again; then a call that takes them makes
    the batches that failed, and only those; a last start finds nothing to do."""
    docs, root = table(spark, d, "documents").select("doc_id", "text"), scratch(spark, "batches")
    limit = LONG

    def made(batch):
        import hashlib

        return batch.assign(kept=batch["text"], digest=[hashlib.md5(f"{t}!".encode()).hexdigest() for t in batch["text"]])

    def refusing(batch):
        if batch["text"].str.len().max() > limit:
            raise ValueError("too long")
        return made(batch)

    def run():
        return batches.Run(docs, "doc_id", root, "digest string, kept string", required="kept", files=1, per_file=100)

    with contextlib.suppress(Exception):  # it ends as if it were killed
        run().resume(refusing, stop_after=1)
    with contextlib.suppress(batches.BatchesFailed):
        run().resume(refusing)
    run().resume(made)
    return run().resume(refusing).select("doc_id", "batch", "digest", "status", "attempt")


# --- full rankings and runs -----------------------------------------------------------------------------------------------

_FULL = f"{base._CUT}, " + base._BM25.replace("FROM benchmark", "FROM cut").replace(" QUALIFY rank <= 20", "")


def _full_run(spark, d):
    return runs.FullRun(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", scratch(spark, "full"), budget=6)


@query(f"WITH {_FULL} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM top")
def full_ranking(spark, d):
    """Every document's rank for every item, whose text is cut to six tokens."""
    return _full_run(spark, d).rankings.select("item_id", "doc_id", r("score").alias("score"), "rank")


@query(f"""WITH {_FULL}, t AS (SELECT len({base._tok('text')}) AS n FROM benchmark)
SELECT 'bm25' AS method, 6::BIGINT AS query_budget, count(*) AS queries, count(*) FILTER (n > 6) AS truncated, count(*) FILTER (n = 0) AS blank, sum(least(n, 6))::BIGINT AS query_tokens,
(SELECT count(*) FROM top) AS rows, (SELECT count(*) FROM top WHERE score > 0) AS hits, (SELECT max(rank) FROM top) AS corpus, (SELECT round(max(score), 6) FROM top) AS best_score FROM t""")
def full_ranking_manifest(spark, d):
    """The counts of the run, observed while it wrote."""
    return _full_run(spark, d).manifest.select("method", "query_budget", "queries", "truncated", "blank", "query_tokens", "rows", "hits", "corpus", r("best_score").alias("best_score"))


@query(f"""WITH {_FULL}, p AS (SELECT item_id, doc_id, (n_chars % 97)::DOUBLE AS score FROM top JOIN documents USING (doc_id) WHERE rank <= 20)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p""")
def reranked_pool(spark, d):
    """The first twenty of each full ranking in the order of another score."""
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    scored = lambda pool: pool.join(docs.select("doc_id", (F.col("n_chars") % 97).cast("double").alias("score")), "doc_id")
    run = runs.FullRun(docs, asked, "doc_id", "item_id", scratch(spark, "full"), budget=6, rerank=scored)
    return run.reranked.select("item_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


# --- releases and panels --------------------------------------------------------------------------------------------------

_LINES = """l AS (SELECT doc_id % 4 AS shard, string_agg(line || chr(10), '' ORDER BY doc_id) AS content FROM (SELECT doc_id, concat_ws('|', doc_id, lang, source, md5(text)) AS line FROM documents) GROUP BY ALL),
n AS (SELECT 'documents/shard=' || shard || '/part-00000.txt' AS name, octet_length(encode(content))::BIGINT AS bytes, sha256(content) AS sha256 FROM l)"""


def _released(spark, d):
    path = scratch(spark, "release")
    docs = table(spark, d, "documents").select((F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("_id"), F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.md5("text")).alias("line"))
    release.publish(spark, path, {"documents": docs}, {"source": "documents"}, {"documents": ["shard"]}, {"documents": ["_id"]})
    return path


@query(f"WITH {_LINES} SELECT name, bytes, sha256, (SELECT sha256(string_agg(sha256(name || chr(0) || sha256), '' ORDER BY sha256(name))) FROM n) AS release_id FROM n")
def release_manifest(spark, d):
    """The files of a release of the documents, and its id."""
    path = _released(spark, d)
    named = spark.read.schema("release_id string").json(f"{path}/freeze/release")
    return release.frozen(spark, path).join(named)


@query(f"""WITH {_LINES}, e AS (SELECT doc_id % 4 AS shard, count(*) AS all_rows, count(*) FILTER (n_chars > 300) AS kept FROM documents GROUP BY 1)
SELECT CASE WHEN kept = 0 THEN 'missing' ELSE 'changed' END AS rule, 'documents/shard=' || shard || '/part-00000.txt' AS key FROM e WHERE kept < all_rows
UNION ALL SELECT 'surplus', 'documents/shard=9/part-00000.txt' WHERE EXISTS (SELECT 1 FROM documents WHERE n_chars > 3000)""")
def release_violations(spark, d):
    """A release whose shards were written anew without short documents, and that got a file of long ones."""
    path = _released(spark, d)
    docs = table(spark, d, "documents").withColumn("line", F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.md5("text")))
    system, _ = filesystem(spark, path)
    kept = docs.where("n_chars > 300").groupBy((F.col("doc_id") % 4).alias("shard")).agg(F.count("*").alias("n"))
    every = docs.groupBy((F.col("doc_id") % 4).alias("shard")).agg(F.count("*").alias("m"))
    for row in every.join(kept, "shard", "left").collect():  # four shards
        where = f"{path}/documents/shard={row['shard']}"
        if (row["n"] or 0) < row["m"]:
            system.delete(filesystem(spark, where)[1], True)
        if row["n"] and row["n"] < row["m"]:
            docs.where((F.col("doc_id") % 4 == row["shard"]) & (F.col("n_chars") > 300)).select("doc_id", "line").repartition(1).sortWithinPartitions("doc_id").select("line").write.text(where)
    long = docs.where("n_chars > 3000").select("line")
    if not long.isEmpty():
        long.repartition(1).write.text(f"{path}/documents/shard=9")
    return release.violations(spark, path).select("rule", "key")


_RAW = """n AS (SELECT c_nationkey AS nation, string_agg(c_custkey || '|' || c_name || chr(10), '' ORDER BY c_custkey) AS content, string_agg(c_custkey || '|' || c_name || chr(10), '' ORDER BY c_custkey) FILTER (c_acctbal >= 0) AS was, count(*) AS rows FROM customer GROUP BY 1)"""


@query(f"""WITH {_RAW}, m AS (SELECT nation, 'nation=' || nation || '/part-00000.txt' AS path, CASE WHEN rows % 5 = 0 THEN 'absent_at_source' WHEN rows % 7 = 0 THEN 'lost' ELSE 'downloaded' END AS status, was, content,
  CASE WHEN n_name < 'C' THEN 'http://' ELSE 'https://' END || 'files.example/' || nation AS url FROM n JOIN nation ON n_nationkey = nation)
SELECT 'status' AS rule, path AS key FROM m WHERE status = 'lost' UNION ALL SELECT 'origin', path FROM m WHERE status = 'downloaded' AND url LIKE 'http:%'
UNION ALL SELECT 'changed', path FROM m WHERE status = 'downloaded' AND content <> coalesce(was, '') UNION ALL SELECT 'present', path FROM m WHERE status = 'absent_at_source'
UNION ALL SELECT 'missing', 'nation=' || n_nationkey || '/part-00000.txt' FROM nation ANTI JOIN n ON nation = n_nationkey""")
def source_provenance(spark, d):
    """Customers as a file per nation, against a manifest made when no balance was negative."""
    path = scratch(spark, "raw")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("k"), F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name").alias("line"), "c_acctbal")
    release.write_lines(spark, rows.select("nation", F.col("k").alias("_k"), "line"), path, ["nation"], ["_k"])
    was = rows.where("c_acctbal >= 0 AND nation IS NOT NULL").select(F.col("nation").cast("string").alias("at"), F.lit(None).alias("size"), "line", "k").repartition("at").sortWithinPartitions("at", "k", "line")
    each = rows.groupBy("nation").agg(F.count("*").alias("rows")).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name"), "nation")
    each = each.join(release.line_digests(was).withColumnRenamed("at", "own"), F.col("own") == F.col("nation").cast("string"), "left").withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256)))
    name = F.concat(F.lit("nation="), F.col("nation").cast("string"), F.lit("/part-00000.txt"))
    status = F.when(F.col("rows") % 5 == 0, release.ABSENT).when(F.col("rows") % 7 == 0, "lost").otherwise(release.DOWNLOADED)
    manifest = each.select(name.alias("path"), status.alias("status"), F.concat(F.when(F.col("n_name") < "C", "http://").otherwise("https://"), F.lit("files.example/"), F.col("nation").cast("string")).alias("url"), "sha256")
    expected = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).select(name.alias("path"))
    return release.source_violations(spark, manifest, path, expected, "https://files.example/").select("rule", "key")


_ITEM = """'{"chars":' || n_chars || ',"language":' || to_json(lang) || ',"pages":' || (n_chars / 7.0::DOUBLE)::VARCHAR || ',"tags":[' || to_json(source) || ',null],"text":' || to_json(text) || '}'"""


def _items(spark, d):
    return table(spark, d, "documents").withColumn("item", F.struct("text", F.col("lang").alias("language"), F.array("source", F.lit(None)).alias("tags"), F.col("n_chars").alias("chars"), (F.col("n_chars") / F.lit(7.0)).alias("pages")))


@query(f"SELECT doc_id, sha256({_ITEM}) AS sha256 FROM documents")
def item_fingerprints(spark, d):
    """A digest of each document as a nested record in canonical JSON."""
    items = _items(spark, d)
    return items.select("doc_id", canonical.fingerprint(items, "item").alias("sha256"))


_PANEL = f"""g AS (SELECT doc_id, lang AS grp FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 20
UNION SELECT doc_id, 'seen ' || source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1),
p AS (SELECT doc_id, string_agg(grp, ',' ORDER BY grp) AS groups, count(*) AS n FROM g GROUP BY doc_id), i AS (SELECT p.*, sha256({_ITEM}) AS condition_sha256 FROM p JOIN documents USING (doc_id))"""


def _panel(spark, d):
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    longest = docs.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).where("k <= 20").select("doc_id", F.col("lang").alias("group"))
    first = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.concat(F.lit("seen "), "source").alias("group"))
    return panels.frozen_panel(longest.union(first), _items(spark, d), "doc_id", "item")


@query(f"WITH {_PANEL} SELECT doc_id, groups, condition_sha256 FROM i")
def panel_items(spark, d):
    """The longest documents of each language and the first of each source, each once, with digests of their records."""
    return _panel(spark, d).select("doc_id", F.array_join("groups", ",").alias("groups"), "condition_sha256")


@query(f"""WITH {_PANEL}, h AS (SELECT sha256(doc_id || '|' || condition_sha256) AS h, n FROM i), b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS x, count(*) AS c, sum(n) AS m FROM h GROUP BY 1)
SELECT sha256(string_agg(x, '' ORDER BY b)) AS panel_sha256, sum(c)::BIGINT AS items, (SELECT count(DISTINCT conv_id) FROM conversations) AS cases, sum(c)::BIGINT * (SELECT count(DISTINCT conv_id) FROM conversations) AS pairs, sum(m)::BIGINT AS memberships_per_case FROM b""")
def panel_release(spark, d):
    return panels.panel_row(_panel(spark, d), table(spark, d, "conversations"), "doc_id", "conv_id")


# --- generated cases ------------------------------------------------------------------------------------------------------


def _recipes(spark, d, *facts):
    """A case for each customer, with facts of its own; 24 customers in a row share a seed."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(*facts, key.alias("case"), (key % 24 + 1).cast("int").alias("recipe"), F.concat(F.lit("s"), F.expr("c_custkey div 24").cast("string")).alias("seed"))


def _noise(metric: str, half: int, recipe: str = "coalesce(map {5: 3, 11: 9, 18: 16, 23: 21, 24: 22}[recipe], recipe)", day: str = "n") -> str:
    return f"(('0x' || substr(md5(seed || '|' || {recipe} || '|{metric}|' || {day}), 1, 8))::BIGINT % {2 * half + 1} - {half})"


_CASES = "c AS (SELECT c_custkey AS \"case\", (c_custkey % 24 + 1)::INTEGER AS recipe, 's' || c_custkey // 24 AS seed FROM customer), d AS (SELECT c.*, unnest(range(42))::INTEGER AS n FROM c)"
_SWAP = "CASE WHEN n < 28 THEN n WHEN n < 35 THEN n + 7 ELSE n - 7 END"
_TURN = "CASE WHEN n IN (29, 31, 33) THEN n + 7 WHEN n IN (36, 38, 40) THEN n - 7 ELSE n END"


@query(f"""WITH {_CASES}, x AS (SELECT *, CASE recipe WHEN 5 THEN {_SWAP} WHEN 23 THEN {_TURN} ELSE n END AS s FROM d WHERE recipe IN (3, 5, 21, 23))
SELECT "case", recipe, n, (CASE WHEN recipe IN (3, 5) THEN CASE WHEN s < 35 THEN 480 ELSE 360 END + {_noise("sleep", 8, day="s")}
WHEN n < 28 THEN 470 + {_noise("sleep", 8, day="s")} ELSE CASE WHEN s IN (29, 31, 33, 37, 39, 41) THEN 390 ELSE 480 END + {_noise("sleep", 6, day="s")} END)::INTEGER AS sleep FROM x""")
def matched_sleep(spark, d):
    """Sleep of two matched pairs of recipes: blocks in reverse order, and short nights after other days."""
    return generator.generated_cases(_recipes(spark, d).where("recipe IN (3, 5, 21, 23)")).select("case", "recipe", "n", "sleep")


@query(f"""WITH {_CASES}, y AS (SELECT *, n >= 28 AND recipe IN (16, 18) AS styled, recipe = 8 AND n = 36 AS unworn FROM d), m AS (SELECT "case", n, styled, recipe, unworn,
CASE WHEN styled THEN 480 WHEN recipe = 20 AND n >= 28 THEN 600 + {_noise("low", 8)} ELSE 450 + {_noise("low", 12)} END AS low,
CASE WHEN n < 28 THEN 55 + {_noise("activity", 5)} WHEN recipe = 14 THEN [0, 5, 8, 4, 10, 2, 6, 5, 7, 0, 9, 3, 5, 4][n - 27] WHEN recipe = 20 THEN 10 + {_noise("activity", 2)}
  WHEN recipe IN (21, 23) THEN CASE WHEN n IN (28, 30, 32, 36, 38, 40) THEN 90 ELSE 45 END ELSE 55 + {_noise("activity", 5)} END AS activity FROM y)
SELECT "case", n, CASE WHEN NOT unworn THEN low END::INTEGER AS low, CASE WHEN NOT unworn THEN activity END::INTEGER AS activity, CASE WHEN unworn THEN 0 ELSE low END::INTEGER AS low_minutes,
CASE WHEN unworn THEN 0 ELSE activity END::INTEGER AS active_minutes, CASE WHEN unworn THEN 0 WHEN styled AND recipe = 16 THEN 3 WHEN styled THEN 32 ELSE 10 END::INTEGER AS low_bouts, false AS meet FROM m""")
def generated_intervals(spark, d):
    """Minutes and bouts of each case's intervals against the day's metrics; whether activity and low movement meet."""
    days = generator.generated_cases(_recipes(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, i: s + i["end"] - i["start"]).alias(f"{c.split('_')[0]}_minutes")
    meet = F.exists("low_intervals", lambda a: F.exists("activity_intervals", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return days.select("case", "n", "low", "activity", total("low_intervals"), total("activity_intervals").alias("active_minutes"), F.size("low_intervals").alias("low_bouts"), meet.alias("meet"))


@query("""WITH c AS (SELECT c_custkey % 24 + 1 AS recipe FROM customer) SELECT CASE WHEN recipe <= 6 THEN 'single_variable' WHEN recipe <= 12 THEN 'personal_baseline' WHEN recipe <= 18 THEN 'temporal_pattern' ELSE 'multivariable' END AS case_type,
CASE WHEN recipe IN (1, 2, 7, 10, 13, 14, 19, 20) THEN 'A' WHEN recipe IN (3, 4, 8, 9, 15, 16, 21, 22) THEN 'B' ELSE 'C' END AS stratum, count(*) AS cases FROM c GROUP BY ALL""")
def generated_strata(spark, d):
    return generator.case_facts(_recipes(spark, d)).groupBy("case_type", "stratum").agg(F.count("*").alias("cases"))


# --- aliases, packets, packing, newer rules, failures ---------------------------------------------------------------------

_ALIASED = """l AS (SELECT DISTINCT l_orderkey AS o, 'condition_index.' || l_linenumber AS a, 'part-' || l_partkey AS t FROM lineitem),
g AS (SELECT o, a, t FROM l QUALIFY count(*) OVER (PARTITION BY o, a) = 1 AND count(*) OVER (PARTITION BY o, t) = 1),
u AS (SELECT o_orderkey AS o, unnest(range(1, 2 + length(o_orderpriority) % 3)) AS k FROM orders),
j AS (SELECT u.o, u.k, 'condition_index.' || u.k AS a, g.t FROM u LEFT JOIN g ON g.o = u.o AND g.a = 'condition_index.' || u.k),
s AS (SELECT o, count(*) FILTER (t IS NULL) AS missing FROM j GROUP BY o)"""


def _aliased(spark, d):
    """Orders that cite lines by their numbers, in a list and in a list of judgments."""
    n = 1 + F.length("o_orderpriority") % 3
    refs = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("condition_index."), k.cast("string")))
    judged = F.transform(refs, lambda x: F.struct(x.alias("condition_id"), F.col("o_orderstatus").alias("state")))
    docs = table(spark, d, "orders").select("o_orderkey", F.struct(F.concat(F.array(F.lit("fixed")), refs).alias("conditions"), judged.alias("judgments"), F.lit("condition_index.1").alias("note")).alias("record"))
    proofs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("condition_index."), F.col("l_linenumber").cast("string")).alias("alias"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("target"))
    return docs, proofs


@query(f"""WITH {_ALIASED} SELECT o AS o_orderkey, 'fixed,' || string_agg(CASE WHEN missing = 0 THEN t ELSE a END, ',' ORDER BY k) AS conditions, string_agg(CASE WHEN missing = 0 THEN t ELSE a END, ',' ORDER BY k) AS judged,
'condition_index.1' AS note, coalesce(string_agg(a, ',' ORDER BY k) FILTER (t IS NULL), '') AS unproven FROM j JOIN s USING (o) GROUP BY o""")
def alias_rewrites(spark, d):
    """The orders with the lines' parts in place of the numbers, where all of an order's numbers are proven."""
    docs, proofs = _aliased(spark, d)
    out = aliases.rewritten(docs, "o_orderkey", "record", ["conditions", "condition_id"], r"^condition_index\.\d+$", proofs, "alias", "target")
    return out.select("o_orderkey", F.array_join("record.conditions", ",").alias("conditions"), F.array_join(F.col("record.judgments.condition_id"), ",").alias("judged"), "record.note", F.array_join("unproven", ",").alias("unproven"))


@query(f"""WITH {_ALIASED} SELECT o AS o_orderkey, a AS alias, t AS target, CASE WHEN count(*) OVER (PARTITION BY o, a) > 1 THEN 'ambiguous alias' WHEN count(*) OVER (PARTITION BY o, t) > 1 THEN 'shared target' END AS fault FROM l QUALIFY fault IS NOT NULL""")
def alias_faults(spark, d):
    return aliases.proven(_aliased(spark, d)[1], "o_orderkey", "alias", "target").where("fault IS NOT NULL")


_HOSTS = """h AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, html, CASE WHEN length(html) >= 3000 THEN 'primary' WHEN length(html) >= 1500 THEN 'web' ELSE 'unavailable' END AS kind FROM pages),
b AS (SELECT r.page_id, r.host, s.kind, s.page_id AS snapshot FROM h r JOIN h s ON s.host = r.host AND s.page_id < r.page_id AND s.kind <> 'unavailable'
  QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY s.kind, s.page_id DESC) = 1), best AS (SELECT h.page_id, b.kind, b.snapshot FROM h LEFT JOIN b USING (page_id))"""


def _snapshots(spark, d):
    """For each page, the last earlier page of its host, a long one before a short one."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), "html")
    kind = F.when(F.length("html") >= 3000, "primary").when(F.length("html") >= 1500, "web").otherwise("unavailable")
    known = pages.select("host", F.col("page_id").alias("at"), kind.alias("kind"), F.col("page_id").alias("snapshot"))
    asked = pages.select("host", (F.col("page_id") - 1).alias("at"), "page_id")
    return pages, snapshots.best_before(asked, known, "host", "at", "kind", ["primary", "web"], ["snapshot"], width=64)


@query(f"WITH {_HOSTS} SELECT page_id, kind, snapshot FROM best")
def best_snapshots(spark, d):
    return _snapshots(spark, d)[1].select("page_id", "kind", "snapshot")


@query(f"""WITH RECURSIVE {_HOSTS}, p AS (SELECT best.page_id, unnest(range(len(x))) AS place, unnest(x) AS line, t FROM best JOIN (SELECT page_id AS snapshot, string_split(html, chr(10)) AS x FROM h) USING (snapshot)
  JOIN (SELECT page_id, list_distinct(regexp_extract_all(lower(html), '[a-z]{{4,}}')) AS t FROM h) w ON w.page_id = best.page_id),
o AS (SELECT page_id, place, octet_length(encode(line)) AS n, row_number() OVER (PARTITION BY page_id ORDER BY -len(list_intersect(list_distinct(regexp_extract_all(lower(line), '[a-z]{{4,}}')), t)), place) AS k FROM p),
f AS (SELECT page_id, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT page_id FROM o)
  UNION ALL SELECT o.page_id, o.k, CASE WHEN used + n <= 900 THEN used + n ELSE used END, CASE WHEN used + n <= 900 THEN list_append(kept, place) ELSE kept END FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1)
SELECT page_id, arg_max(used, k)::BIGINT AS used, array_to_string(list_sort(arg_max(kept, k)), ',') AS kept FROM f GROUP BY page_id""")
def source_packets(spark, d):
    """The lines of each page's best snapshot that share most words with the page, within 900 bytes."""
    pages, best = _snapshots(spark, d)
    terms = pages.select("page_id", F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("[a-z]{4,}"), F.lit(0))).alias("terms"))
    lines = pages.select(F.col("page_id").alias("snapshot"), F.posexplode(F.split("html", "\n")).alias("place", "line"))
    parts = best.where("snapshot IS NOT NULL").select("page_id", "snapshot").join(lines, "snapshot").join(terms, "page_id")
    out = snapshots.packets(parts, ["page_id"], "place", "line", F.col("terms"), 900)
    return out.select("page_id", "used", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query("""WITH RECURSIVE t AS (SELECT role, conv_id, turn, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations),
f AS (SELECT role, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, 0::BIGINT AS k, -1::BIGINT AS batch, 0::BIGINT AS fill FROM (SELECT DISTINCT role FROM t)
  UNION ALL SELECT t.role, t.conv_id, t.turn, t.k, CASE WHEN f.batch < 0 OR fill + n > 2500 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.batch < 0 OR fill + n > 2500 THEN n ELSE fill + n END FROM f JOIN t ON t.role = f.role AND t.k = f.k + 1)
SELECT role, conv_id, turn, batch FROM f WHERE k > 0""")
def ceiling_batches(spark, d):
    """Turns of a role in batches of at most 2,500 bytes, in their order."""
    rows = table(spark, d, "conversations").withColumn("bytes", F.octet_length("text"))
    return packing.next_fit(rows, "role", ["conv_id", "turn"], "bytes", 2500)


_CHECKED = """c AS (SELECT doc_id, (len(text) % 3)::INTEGER AS v, list_filter([CASE WHEN n_chars > 500 THEN 'VALID_EVIDENCE' END, CASE WHEN contains(text, '@') THEN 'INVALID_REFERENCE' END, CASE WHEN lang = 'de' THEN 'OTHER' END], lambda x: x IS NOT NULL) AS st FROM documents)"""


def _audits(spark, d):
    statuses = F.array_compact(F.array(F.when(F.col("n_chars") > 500, "VALID_EVIDENCE"), F.when(F.contains("text", F.lit("@")), "INVALID_REFERENCE"), F.when(F.col("lang") == "de", "OTHER")))
    none = F.array().cast("array<string>")
    return table(spark, d, "documents").select("doc_id", statuses.alias("statuses"), none.alias("errors"), F.lit(True).alias("usable"), (F.char_length("text") % 3).cast("int").alias("validator_version"))


@query(f"""WITH {_CHECKED}, e AS (SELECT *, list_filter([CASE WHEN len(st) = 0 OR list_contains(st, 'OTHER') THEN 'statuses' END, CASE WHEN list_contains(st, 'VALID_EVIDENCE') AND len(st) > 1 THEN 'contradiction' END], lambda x: x IS NOT NULL) AS er FROM c)
SELECT doc_id, array_to_string(st, ',') AS statuses, CASE WHEN v < 2 THEN array_to_string(er, ',') ELSE '' END AS errors, CASE WHEN v < 2 THEN len(er) = 0 ELSE true END AS usable, greatest(v, 2)::INTEGER AS validator_version FROM e""")
def revalidated_audits(spark, d):
    """Stored audits under the second version of the rules, done twice."""
    rules = {"statuses": (F.size("statuses") > 0) & ~F.array_contains("statuses", "OTHER"), "contradiction": ~F.array_contains("statuses", "VALID_EVIDENCE") | (F.size("statuses") == 1)}
    once = snapshots.revalidated(_audits(spark, d), 2, rules)
    return snapshots.revalidated(once, 2, rules).select("doc_id", F.array_join("statuses", ",").alias("statuses"), F.array_join("errors", ",").alias("errors"), "usable", "validator_version")


# --- retrieval runs and failures ------------------------------------------------------------------------------------------

_RECORDS = f"""k AS (SELECT item_id, {base._tok('text')} AS t FROM benchmark), s AS (SELECT item_id, unnest(CASE WHEN len(t) >= 15 THEN [0, 1, 2, 3, 4] ELSE [0] END) AS slot, t FROM k),
z AS (SELECT item_id, slot, item_id || '/' || slot AS run, CASE WHEN len(t) >= 15 THEN array_to_string(t[slot * (len(t) // 5) + 1:(slot + 1) * (len(t) // 5)], ' ') ELSE array_to_string(t, ' ') END AS text FROM s)"""
_RUN = _RECORDS + ", " + base._BM25.replace("item_id", "run").replace("FROM benchmark", "FROM z") + """, fused AS (SELECT item_id, doc_id, round(sum(1 / (60.0::DOUBLE + rank)), 12) AS score FROM top JOIN z USING (run) GROUP BY 1, 2),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 20)"""


def _retrieval_run(spark, d):
    """Long items as records in five parts, short ones as one query; rankings per slot, fused."""
    t, n = words.tokens("text"), F.size("t")
    items = table(spark, d, "benchmark").select("item_id", t.alias("t"))
    fifth = F.floor(n / 5).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.array_join(F.slice("t", (k * fifth + 1).cast("int"), fifth), " "))
    asked, _ = runs.queries(items.withColumn("slots", parts).withColumn("whole", F.array_join("t", " ")), "item_id", n >= 15, "slots", "whole")
    return runs.run(table(spark, d, "documents").select("doc_id", "text"), asked, "doc_id", "item_id")


@query(f"WITH {_RUN} SELECT item_id, doc_id, round(score, 9) AS score, rank FROM ranked")
def retrieval_run(spark, d):
    return _retrieval_run(spark, d).select("item_id", "doc_id", r("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {_RUN}, g AS (SELECT item_id, max(slot) > 0 AS parts FROM z GROUP BY 1), n AS (SELECT item_id, count(*) AS n, parts FROM ranked JOIN g USING (item_id) GROUP BY ALL),
cut AS (SELECT r.*, parts FROM ranked r JOIN n USING (item_id) WHERE NOT (parts AND rank = n))
SELECT 'size' AS rule, item_id::VARCHAR AS key FROM n WHERE n - parts::INTEGER <> 20 AND n - parts::INTEGER > 0
UNION ALL SELECT 'value', item_id || '|' || rank || '|' || doc_id FROM ranked JOIN n USING (item_id) WHERE (parts AND rank = n) OR (NOT parts AND rank = 1)""")
def retrieval_run_violations(spark, d):
    """A saved run, in which fused rankings lost their last row and others another first score, against one computed again."""
    from tideline.sources.shared import settled

    again = settled(_retrieval_run(spark, d), "run")
    parts = table(spark, d, "benchmark").select("item_id", (F.size(words.tokens("text")) >= 15).alias("parts"))
    last = again.groupBy("item_id").agg(F.max("rank").alias("last")).join(parts, "item_id")
    saved = again.join(last, "item_id").where(~(F.col("parts") & (F.col("rank") == F.col("last"))))
    saved = saved.withColumn("score", F.when(~F.col("parts") & (F.col("rank") == 1), F.col("score") + 1).otherwise(F.col("score"))).select("item_id", "doc_id", "score", "rank")
    return runs.violations(saved, again, "item_id", "doc_id").select("rule", "key")


_CASES_OF = f"""{base._GOLD}, {base._CUT}, a AS (WITH {base._BM25} SELECT * FROM top), b AS (WITH {base._BM25.replace('FROM benchmark', 'FROM cut')} SELECT * FROM top),
ma AS (WITH {base._metrics('item_id', 'doc_id', 'a')} SELECT * FROM m), mb AS (WITH {base._metrics('item_id', 'doc_id', 'b')} SELECT * FROM m),
ha AS (SELECT item_id, doc_id FROM a SEMI JOIN gold USING (item_id, doc_id) WHERE rank <= 10), hb AS (SELECT item_id, doc_id FROM b SEMI JOIN gold USING (item_id, doc_id) WHERE rank <= 10),
re AS (SELECT item_id, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM hb ANTI JOIN ha USING (item_id, doc_id) GROUP BY 1), lo AS (SELECT item_id, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM ha ANTI JOIN hb USING (item_id, doc_id) GROUP BY 1),
fn AS (SELECT item_id, count(*) AS n FROM gold g ANTI JOIN ha USING (item_id, doc_id) WHERE relevance >= 1 GROUP BY 1)"""


@query(f"""WITH {_CASES_OF}, x AS (SELECT item_id, (SELECT count(*) FROM a WHERE a.item_id = ma.item_id) AS shown, coalesce(fn.n, 0) AS missed, coalesce(re.docs, '') AS recovered, coalesce(lo.docs, '') AS lost,
  mb.ndcg10 - ma.ndcg10 AS gain, 1 - ma.strong_recall10 AS miss FROM ma JOIN mb USING (item_id) LEFT JOIN fn USING (item_id) LEFT JOIN re USING (item_id) LEFT JOIN lo USING (item_id))
SELECT item_id, shown, missed, recovered, lost, round(gain, 6) AS gain, coalesce(round(gain, 9) >= 0.05, false) AS visible_gain, row_number() OVER (ORDER BY coalesce(miss, 0) DESC, item_id) AS place FROM x""")
def failure_records(spark, d):
    """Each item's rankings by its whole and its cut text, metrics, what was missed, recovered and lost, as one nested record; then its
    place among the failures."""
    from tideline.sources.shared import settled

    docs, asked, two = table(spark, d, "documents"), table(spark, d, "benchmark"), passages(spark, d)
    method = {"whole": asked, "cut": asked.withColumn("text", words.truncated(F.col("text"), 6))}
    ranked = {m: settled(retrieval.bm25(docs, q, "doc_id", "item_id"), m) for m, q in method.items()}
    # labels of ranked documents only, forty at most, and an item's number of others: its labels grow with the documents
    pairs = ranked["whole"].select("item_id", "doc_id").union(ranked["cut"].select("item_id", "doc_id")).distinct()
    relevant, grades = settled(relevance(spark, d, two, pairs), "relevant"), settled(grade_counts(spark, d, two), "grades")
    parts: dict = {"gold": (relevant, ["doc_id"]), "grades": (grades, ["relevance"])}
    for m, top in ranked.items():
        parts[m] = (top.select("item_id", "rank", "doc_id", "score"), ["rank"])
        parts[f"{m}_metrics"] = (evaluation.ranking_metrics(top, relevant, ["item_id"], "item_id", "doc_id", grades), [])
    nested = snapshots.assembled(parts, "item_id").where(F.size("whole") > 0)
    good = lambda m: F.array_intersect(F.transform(F.filter(m, lambda x: x["rank"] <= 10), lambda x: x["doc_id"]), F.transform("gold", lambda g: g["doc_id"]))
    value = lambda m, c: F.col(f"{m}_metrics")[0][c]
    rows = nested.select(
        "item_id", F.size("whole").cast("long").alias("shown"), (F.aggregate("grades", F.lit(0).cast("long"), lambda s, g: s + g["n"]) - F.size(good("whole"))).alias("missed"),
        F.array_join(F.array_sort(F.array_except(good("cut"), good("whole"))).cast("array<string>"), ",").alias("recovered"), F.array_join(F.array_sort(F.array_except(good("whole"), good("cut"))).cast("array<string>"), ",").alias("lost"),
        r(value("cut", "ndcg10") - value("whole", "ndcg10"), 9).alias("gain"), (1 - value("whole", "strong_recall10")).alias("miss"),
    )
    out = snapshots.failures(rows, "item_id", "miss", "gain")
    return out.select("item_id", "shown", "missed", "recovered", "lost", r("gain").alias("gain"), "visible_gain", "place")


# --- the evaluation of a run ----------------------------------------------------------------------------------------------


def _evaluated(spark, d):
    from tideline.operators import evaluated
    from tideline.sources import corpus

    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    kept, relevant = docs.select("doc_id", "lang", F.sha2("text", 256).alias("item_sha256")), gold(spark, d)
    manifest = spark.createDataFrame([(corpus.corpus_digest(kept),)], "corpus_sha256 string")
    top = None
    for method, q in (("whole", asked), ("cut", asked.withColumn("text", words.truncated(F.col("text"), 6)))):
        one = retrieval.bm25(docs, q, "doc_id", "item_id").select(F.lit(method).alias("method"), F.lit(1).alias("repeat"), "item_id", "doc_id", "rank")
        top = one if top is None else top.unionByName(one)
    path = scratch(spark, "evaluation")
    evaluated.evaluate(spark, path, top, relevant, kept, manifest, "item_id", "doc_id", "lang", F.expr("item_id div 4"), draws=200)
    return path


@query(f"""WITH {_CASES_OF}, m AS (SELECT 'whole' AS method, * FROM ma UNION ALL SELECT 'cut', * FROM mb)
SELECT method, {", ".join(f"round(avg({c}), 6) AS {c}, count({c}) AS {c}_valid" for c in ("recall10", "strong_recall10", "ndcg10", "irrelevant10"))}, count(*) AS cases FROM m GROUP BY method""")
def evaluation_summary(spark, d):
    """Of whole and cut queries, as published by the evaluation."""
    rows = spark.read.schema("method string, recall10 double, recall10_valid long, strong_recall10 double, strong_recall10_valid long, ndcg10 double, ndcg10_valid long, irrelevant10 double, irrelevant10_valid long, cases long").json(f"{_evaluated(spark, d)}/summary")
    return rows.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query(f"""WITH {_CASES_OF}, t AS (SELECT 'whole' AS method, * FROM a UNION ALL SELECT 'cut', * FROM b), l AS (SELECT doc_id, lang FROM documents),
h AS (SELECT method, item_id, lang, count(*) AS returned, count(*) FILTER (relevance >= 1) AS hits FROM t JOIN l USING (doc_id) LEFT JOIN gold USING (item_id, doc_id) WHERE rank <= 10 GROUP BY ALL),
w AS (SELECT item_id, lang, count(*) FILTER (relevance >= 1) AS positives FROM gold JOIN l USING (doc_id) GROUP BY ALL), r AS (SELECT DISTINCT method, item_id FROM t),
k AS (SELECT method, item_id, lang FROM r JOIN w USING (item_id) UNION SELECT method, item_id, lang FROM h),
p AS (SELECT method, item_id, lang, coalesce(hits, 0) / nullif(positives, 0)::DOUBLE AS recall10, coalesce(returned, 0) / 10.0::DOUBLE AS share10 FROM k LEFT JOIN h USING (method, item_id, lang) LEFT JOIN w USING (item_id, lang))
SELECT method, lang, round(avg(recall10), 6) AS recall10, count(recall10) AS recall10_valid, round(avg(share10), 6) AS share10, count(*) AS cases FROM p GROUP BY ALL""")
def evaluation_groups(spark, d):
    """By language of the documents, as published."""
    rows = spark.read.schema("method string, lang string, recall10 double, recall10_valid long, share10 double, cases long").json(f"{_evaluated(spark, d)}/group_breakdown")
    return rows.select("method", "lang", r("recall10").alias("recall10"), "recall10_valid", r("share10").alias("share10"), "cases")


@query("""WITH c AS (SELECT user_id, user_id || '/' || ts::DATE AS "case", ts::DATE AS day, bool_or(event_type = 'error') AS seen FROM events GROUP BY ALL),
f AS (SELECT * FROM c WHERE user_id NOT IN (SELECT user_id FROM c WHERE seen AND day < DATE '2024-01-03')) SELECT user_id, min("case") AS "case", min(day)::VARCHAR AS day FROM f GROUP BY user_id""")
def exposure_plan(spark, d):
    """The first day of each user none of whose first two days had an error."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    cases_ = e.groupBy("user_id", "day").agg(F.max(F.col("event_type") == "error").alias("seen")).withColumn("case", F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")))
    exposed = cases_.where(F.col("seen") & (F.col("day") < F.lit("2024-01-03").cast("date"))).select("case")
    return panels.exposure_plan(cases_, exposed, "user_id", "case", ["day"]).select("user_id", "case", F.col("day").cast("string").alias("day"))
