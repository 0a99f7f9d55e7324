"""Steps whose cost or result once changed with the size of the tables or the number of partitions."""

from pyspark.sql import functions as F

from tideline.operators import cases
from tideline.sources import generator


def test_cases_of_one_file_are_dealt_out_before_their_days_are_made(spark):
    given = spark.createDataFrame([(k, k, "s", k * 10) for k in range(1, 25)], "case int, recipe int, seed string, fact int").coalesce(1)
    made = generator.generated_cases(given, facts=("fact",))
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert made.where("fact <> recipe * 10 OR fact IS NULL").isEmpty() and made.count() == 24 * 42


def test_rules_of_metrics_are_one_pass(spark):
    days = generator.generated_cases(spark.createDataFrame([(1, 1, "s")], "case int, recipe int, seed string"))
    names = dict(zip(cases.DAY_METRICS + cases.NIGHT_METRICS, ("steps", "activity", "low", "sleep", "rhr", "hrv"), strict=True))
    reasons = F.array().cast("array<string>")
    daily = days.select("case", "day", *[F.col(c).cast("double").alias(n) for n, c in names.items()], F.when(F.col("n") == 3, 100).otherwise(F.col("wear")).alias("wear"), F.col("coverage").alias("night_coverage"), F.map_from_arrays(reasons, reasons).alias("missing"))
    at = lambda m: F.timestamp_add("MINUTE", F.col(m), F.col("day").cast("timestamp_ntz"))
    found = cases.metric_violations(daily, days.select("case", "day", at("sleep_start").alias("start_at"), at("wake").alias("end_at")))
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("wear", "1|2026-03-05", "wear")]


def test_files_of_a_release_have_the_same_names_whatever_the_number_of_partitions(spark):
    from tideline.sources import release, shared

    setting, names, ids = "spark.sql.adaptive.coalescePartitions.enabled", set(), set()
    rows = spark.range(40).select((F.col("id") % 4).alias("shard"), F.col("id").alias("_id"), F.concat(F.lit("line "), "id").alias("line"))
    for coalesced in ("true", "false"):
        spark.conf.set(setting, coalesced)
        try:
            path = shared.scratch(spark, "release")
            names.add(tuple(sorted(r["name"] for r in release.publish(spark, path, {"lines": rows}, {}, {"lines": ["shard"]}, {"lines": ["_id"]}).collect())))
            ids.add(spark.read.json(f"{path}/freeze/release").first()["release_id"])
            assert release.violations(spark, path).isEmpty()
        finally:
            spark.conf.unset(setting)
    assert names == {tuple(f"lines/shard={k}/part-00000.txt" for k in range(4))} and len(ids) == 1


def test_a_reference_to_a_day_of_zeros_exists(spark, tmp_path):
    from tideline.plans.record_queries import resolved_references

    rows = spark.createDataFrame([(1, 7, "click", 0.0), (4, 7, "view", 2.5)], "event_id long, user_id long, event_type string, value double")
    rows.select("*", F.lit("2024-01-02 10:00:00").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    found = {(r["ref"], r["value"], r["status"]) for r in resolved_references(spark, str(tmp_path)).collect()}
    assert found == {("d2.clicks", 0.0, "exists"), ("d5.value", None, "invalid")}


def test_an_attempt_has_a_bounded_number_of_micro_batches(spark):
    import glob

    from tideline.operators import batches
    from tideline.sources import shared

    root = shared.scratch(spark, "batches")
    run = batches.Run(spark.range(160).select("id"), "id", root, "out string", size=4, files=1, per_file=4)
    done = run.resume(lambda b: b[["id"]].assign(out="x"))
    assert done.count() == 160 and done.where("status <> 'completed'").isEmpty()
    assert 1 < len(glob.glob(f"{root.removeprefix('file:')}/results/attempt=1/part=*")) <= batches.PARTS


def test_rankings_are_made_once_for_an_evaluation(spark):
    from tideline.operators import evaluated
    from tideline.sources import corpus, shared

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(m, 1, q, i, i) for m in ("a", "b") for q in (1, 2) for i in (1, 2, 3)], "method string, repeat int, q long, item long, rank int")
    items = spark.createDataFrame([(i, "x", f"{i:064x}") for i in (1, 2, 3)], "item long, lang string, item_sha256 string")
    gold = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 3, 0)], "q long, item long, relevance int")
    manifest = spark.createDataFrame([(corpus.corpus_digest(items),)], "corpus_sha256 string")
    evaluated.evaluate(spark, shared.scratch(spark, "evaluation"), rows.mapInArrow(counted, rows.schema), gold, items, manifest, "q", "item", "lang", F.expr("q"), draws=10)
    assert made.value == rows.count()


def test_ideal_gains_need_no_order_of_labels(spark):
    import math

    from tideline.operators import evaluation

    gold = spark.createDataFrame([(1, i, 2 if i < 4 else 1) for i in range(30)], "q long, item long, relevance int")
    out = evaluation.ranking_metrics(spark.createDataFrame([(1, 0, 1)], "q long, item long, rank int"), gold, ["q"], "q", "item")
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()
    ideal = sum((3 if k <= 4 else 1) / math.log2(k + 1) for k in range(1, 11))
    assert abs(out.first()["ndcg10"] - 3 / ideal) < 1e-12


def test_batches_are_looked_at_in_slices():
    import pyarrow as pa

    from tideline.operators import retrieval

    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array([["a"] * (k % 3) for k in range(2500)])], ["d", "t"])
    parts = list(retrieval._slices([batch]))
    assert [p.num_rows for p in parts] == [1024, 1024, 452]
    assert sum(len(p.column(1).flatten()) for p in parts) == sum(k % 3 for k in range(2500))


def test_tasks_of_proofs_take_a_bounded_number_of_rows(spark, monkeypatch):
    from tideline.operators import aliases
    from tideline.sources import files

    monkeypatch.setattr(files, "PER_TASK", 100)
    proofs = spark.range(2000).select((F.col("id") % 500).alias("scope"), F.concat(F.lit("a."), (F.col("id") % 4).cast("string")).alias("alias"), F.col("id").alias("target"))
    found = aliases.proven(proofs, "scope", "alias", "target")
    assert found.rdd.getNumPartitions() == 20 and found.count() == 2000
    docs = spark.range(500).select(F.col("id").alias("scope"), F.struct(F.lit("a.0").alias("ref")).alias("record"))
    assert aliases.rewritten(docs, "scope", "record", ["ref"], r"^a\.\d+$", proofs, "alias", "target").rdd.getNumPartitions() == 20


def test_documents_are_compared_without_a_shuffle(spark):
    from tideline.operators import values

    rows = spark.createDataFrame([(1, '{"l": [1, {"x": null}], "o": {"a": 1}}', '{"l": [1, {"x": 2}, 3], "o": {"b": 1}}'), (2, '{"n": 1, "0": 2}', '[3]'), (3, "[1, 2]", "[1, 2.0]")], "id int, actual string, expected string")
    found = values.compared(rows, ["id"], "actual", "expected")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {tuple(r) for r in found.collect()} == {(1, "$.l", "length"), (1, "$.l.1.x", "value"), (1, "$.o", "fields"), (2, "$", "length"), (2, "$.0", "value")}


def test_a_task_sends_its_best_vectors_once(spark, monkeypatch):
    from tideline.operators import retrieval

    monkeypatch.setattr(retrieval, "VECTORS", 7, raising=False)
    rows = [(k, [float(k * 37 % 11), 1.0]) for k in range(200)]  # many equal scores
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        sent = []
        monkeypatch.setattr(retrieval, "top_k", lambda scores, *a: sent.append(scores) or scores)
        assert retrieval.dense(vectors, asked, "vec_id", "query_id", k=5).count() == 4 * 2 * 5
        monkeypatch.undo()
        got = {}
        for r in retrieval.dense(vectors, asked, "vec_id", "query_id", k=5).collect():
            got[r["query_id"], r["rank"]] = r["vec_id"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q, (x, y) in rows[::50]:
        best = sorted(rows, key=lambda v: (-(v[1][0] * x + v[1][1] * y), v[0]))[:5]
        assert [got[q, k + 1] for k in range(5)] == [v[0] for v in best]


def test_labels_of_ranked_documents_are_told_without_all_labels(spark, tmp_path):
    from tideline.plans import queries

    d = str(tmp_path)
    docs = [(k, "one two three four five" if k % 7 == 0 else "others", None if k == 14 else "en" if k % 2 else "de", f"s{k % 3}") for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "two three four"), (2, "one two three four five"), (3, "absent words here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    found = [(i, k) for i in (1, 2) for k in range(0, 60, 7)]
    want = {(i, n) for i, k in found for n, *_, lang, source in docs if lang and docs[k][2] == lang and docs[k][3] == source}
    want = {(*p, 2 if p in found else 1) for p in want | set(found)}
    labels = queries.gold(spark, d)
    assert "max(" not in labels._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, labels.collect())) == sorted(want)
    two = queries.passages(spark, d)
    pairs = spark.createDataFrame([(i, k) for i in (1, 2, 3) for k in range(0, 60, 2)], "item_id long, doc_id long")
    assert sorted(map(tuple, queries.relevance(spark, d, two, pairs).collect())) == sorted(w for w in want if w[1] % 2 == 0)
    assert {(r["item_id"], r["relevance"]): r["n"] for r in queries.grade_counts(spark, d, two).collect()} == {(i, g): n for i in (1, 2) for g in (1, 2) if (n := sum(w[0] == i and w[2] == g for w in want))}


def test_cards_are_ordered_side_by_side(spark):
    from tideline.operators import judging

    cards = [(k, [f"i{j}" for j in range(k % 5)], False, [(f"i{a}", f"i{b}", judging.RELATIONS[(a + b + k) % 5]) for a in range(k % 5) for b in range(a + 1, k % 5)]) for k in range(60)]
    df = spark.createDataFrame(cards, "c int, items array<string>, unsure boolean, pairs array<struct<l: string, r: string, q: string>>")
    got = {r["c"]: (r["violations"], r["priority"], r["top_outcome"], r["best_set"]) for r in judging.ordered(df, ["c"]).collect()}
    assert got == {c: judging.preference(items, pairs) for c, items, _, pairs in cards}


def test_sums_of_days_do_not_depend_on_files(spark, tmp_path):
    import duckdb

    from tideline.operators import timeseries
    from tideline.plans.oracles import ORACLES
    from tideline.plans.queries import baseline_extrema_overlap

    days = [(1, 2, [0.1, 0.2, 0.3]), (1, 25, [0.6]), (2, 2, [0.6]), (2, 25, [0.1, 0.2, 0.3]), (3, 2, [0.3, 0.2, 0.1]), (3, 25, [0.6]), (4, 2, [None]), (4, 25, [1.0])]
    rows = [(k, u, f"2024-01-{day:02} 10:00:00", "click" if v == 0.2 else "view", v) for k, (u, day, v) in enumerate((u, day, v) for u, day, vs in days for v in vs)]
    made = lambda part: spark.createDataFrame(part, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1)
    made(rows).write.parquet(f"{tmp_path}/one/events.parquet")
    for late in (True, False):  # the first event of a day is alone in a file, the others follow in another one
        firsts = {min(r[0] for r in rows if r[1:3] == s[1:3]) for s in rows}
        made([r for r in rows if (r[0] in firsts) != late]).write.mode("append").parquet(f"{tmp_path}/two/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/one/events.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["baseline_extrema_overlap"]).fetchall())
    assert want == [(1, 0, 1), (2, 1, 0), (3, 0, 0), (4, 0, 0)]
    for layout in ("one", "two"):
        assert sorted(map(tuple, baseline_extrema_overlap(spark, f"{tmp_path}/{layout}").collect())) == want
    sums = timeseries.totals(spark.read.parquet(f"{tmp_path}/two/events.parquet"), ["user_id", "ts"], ["event_id", "value"], value=F.col("value"), clicks=F.when(F.col("event_type") == "click", F.col("value")))
    got = {(r["user_id"], r["ts"].day): (r["events"], r["value"], r["clicks"]) for r in sums.collect()}
    assert got == {(u, day): (len(vs), None if vs == [None] else sum_in_order(vs), 0.2 if 0.2 in vs else None) for u, day, vs in days}


def sum_in_order(values):
    total = 0.0
    for v in values:  # sum() corrects the error of the doubles it adds
        total += v
    return total


def test_a_failure_record_holds_no_labels_of_documents_that_are_not_ranked(spark, tmp_path, monkeypatch):
    from tideline.operators import snapshots
    from tideline.plans import run_queries

    docs = [(k, "one two three four five" if k < 3 else f"other words {k}", "en" if k % 2 else None, "s") for k in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "two three four"), (2, "absent text here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    most = []

    def assembled(parts, key, f=snapshots.assembled):
        most.extend(df.groupBy(key).count().agg(F.max("count")).first()[0] for df, _ in parts.values())
        return f(parts, key)

    monkeypatch.setattr(snapshots, "assembled", assembled)
    found = {r["item_id"]: (r["shown"], r["missed"], r["recovered"], r["lost"]) for r in run_queries.failure_records(spark, str(tmp_path)).collect()}
    assert max(most) <= 40  # of item 1, 152 labels: the odd documents, and two of no language
    assert found[1][1] == 152 - 7  # 0, 1 and 2, and of equal scores of nothing 3, 5, 7 and 9


def test_files_are_hashed_whatever_their_bytes(spark, tmp_path):
    import gzip
    import hashlib
    import random

    from tideline.sources import release

    mark, rng = b"\xef\xbb\xbf", random.Random(3)
    own = {"a.txt": b"one\ntwo\n", "b.txt": b"one\r\ntwo", "mark.txt": mark, "c.txt": mark + b"x\n\n", "d.txt": mark + b"x", "e.txt": b"\n", "f.txt": b"\n\n\nx", "g.txt": mark + b"\n", "z.gz": gzip.compress(b"hidden\n" * 900), "bad.gz": b"no gzip\n", "none": rng.randbytes(3000), "a b%20=.bin": rng.randbytes(200_000), "x/y=1/p.json": b'{"a": 1}\n' * 30_000}
    for name, data in own.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    setting = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(setting, "1000")
    try:
        got = {r["name"]: (r["bytes"], r["sha256"]) for r in release.files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(setting)
    assert got == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in own.items()}


def test_the_size_of_a_file_changes_no_verdict(spark, tmp_path, monkeypatch):
    from tideline.sources import release

    monkeypatch.setattr(release, "MOST", 10, raising=False)  # once, larger files had no digest
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_bytes(b"line\n" * 100)
    manifest = spark.createDataFrame([("a.txt", release.DOWNLOADED, "https://x/a", "0" * 64)], "path string, status string, url string, sha256 string")
    assert [r["rule"] for r in release.source_violations(spark, manifest, str(tmp_path / "raw"), manifest.select("path"), "https://x/").collect()] == ["changed"]
    assert release.publish(spark, str(tmp_path / "release"), {"n": spark.range(50).coalesce(1)}).first()["sha256"]
