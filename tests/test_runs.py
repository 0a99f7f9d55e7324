"""Budgets, resumable batches, whole rankings, releases, canonical JSON: against plain Python, and with planted failures."""

import glob
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tideline.functions import canonical
from tideline.operators import batches, ledger, panels, runs
from tideline.sources import release, shared
from tideline.sources.records import Rejected


def test_refused_requests_take_nothing(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), k, rng.choice([None, *map(str, range(60))]), rng.choice([None, *range(1, 40)]), rng.choice([None, 0, 3])) for k in range(400)]
    rows = [(a, k, r, c, None if x is None or c is None else min(x, c)) for a, k, r, c, x in rows]
    df = spark.createDataFrame(rows, "name string, k long, request string, cost long, charged long").repartition(4)
    got = {(r["name"], r["k"]): (r["status"], r["attempt"], r["used"]) for r in ledger.reservations(df, "name", ["k"], "request", "cost", "charged", 300, 25).collect()}
    some = set()
    for name in "ab":
        used, seen = 0, []
        for _, k, request, cost, charged in sorted(r for r in rows if r[0] == name):
            if request is not None and request in seen:
                want = ("cached", seen.index(request), used)
            elif cost is not None and len(seen) < 25 and used + cost <= 300:
                seen.append(request)
                used += cost if charged is None else charged
                want = ("reserved", len(seen) - 1, used)
            else:
                want = ("refused", None, used)
            assert got[name, k] == want
            some.add(want[0])
    assert some == {"cached", "reserved", "refused"}
    tail = spark.createDataFrame([("a", 1, "x", 7, None), ("a", 2, "y", 5, None), ("a", 3, "z", 3, None)], df.schema)
    assert [r["status"] for r in ledger.reservations(tail, "name", ["k"], "request", "cost", "charged", 10, 9).orderBy("k").collect()] == ["reserved", "refused", "reserved"]
    assert ledger.reservations(tail.limit(0), "name", ["k"], "request", "cost", "charged", 10, 9).collect() == []


def test_a_stopped_run_gives_each_key_once(spark):
    items = spark.range(90).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text"))
    root = shared.scratch(spark, "batches")

    def answer(batch, bad=None, odd=None):
        if bad is not None and (batch["id"] == bad).any():
            raise RuntimeError("planted")
        out = batch[["id"]].assign(out=[None if i == 7 else f"{t}!" for i, t in zip(batch["id"], batch["text"])])
        return out[out["id"] != odd]  # an answer that lacks a key is no answer

    def run(rows=items):
        return batches.Run(rows, "id", root, "out string", size=4, required="out", files=1, per_file=30)

    with pytest.raises(Exception, match="stopped"):
        run().resume(lambda b: answer(b, bad=11, odd=50), stop_after=1)
    first = run().results().count()
    assert 0 < first < 90 and run().attempts() == [1]
    with pytest.raises(batches.BatchesFailed, match="2 batches"):
        run().resume(lambda b: answer(b, bad=11, odd=50))
    found = run().results()
    failed = {r["id"] for r in found.where("status = 'failed'").collect()}
    assert {11, 50} <= failed and len(failed) <= 8 and found.count() == 90 and run().attempts() == [1]
    assert {r["error"] for r in found.where("id IN (11, 50)").collect()} == {"RuntimeError: planted", "ValueError: missing, repeated or unknown keys in the answer"}
    done = run().resume(answer).orderBy("id").collect()
    assert [r["id"] for r in done] == list(range(90)) and {r["id"] for r in done if r["attempt"] == 2} == failed
    assert [r["id"] for r in done if r["status"] == "empty_output"] == [7] and all(r["out"] == f"t{r['id']}!" for r in done if r["id"] != 7)
    assert run().resume(lambda b: 1 / 0).count() == 90 and run().attempts() == [1, 2]  # nothing is left to do
    with pytest.raises(Rejected, match="input changed"):
        run(items.withColumn("text", F.upper("text"))).resume(answer)
    with pytest.raises(Rejected, match="duplicate"):
        batches.Run(items.union(items.limit(1)), "id", shared.scratch(spark, "b"), "out string").resume(answer)


def test_whole_rankings_need_no_task_per_query(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 6), i, rng.randrange(12) / 4) for i in range(3000)]
    got = runs.ranked_whole(spark.createDataFrame(rows, "q long, item long, score double").repartition(7), "q", "item").collect()
    for q in range(6):
        want = sorted((-s, i) for a, i, s in rows if a == q)
        assert [(r["item"], r["rank"]) for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == [(i, k + 1) for k, (_, i) in enumerate(want)]


def test_a_full_run_is_written_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma"), (3, None), (None, "alpha")], "doc long, text string")
    asked = spark.createDataFrame([(1, "beta alpha delta"), (2, ""), (3, "gamma")], "q long, text string")
    path = shared.scratch(spark, "full")
    run = runs.FullRun(docs, asked, "doc", "q", path, budget=2)
    said = run.manifest.first()
    assert (said["queries"], said["truncated"], said["blank"], said["query_tokens"], said["rows"], said["corpus"]) == (3, 1, 1, 3, 6, 3)
    assert said["hits"] == run.rankings.where("score > 0").count() == 3
    assert [(r["q"], r["doc"]) for r in run.rankings.orderBy("q", "rank").collect()] == [(1, 1), (1, 2), (1, 3), (3, 2), (3, 1), (3, 3)]
    with pytest.raises(Rejected, match="exists"):
        runs.FullRun(docs, asked, "doc", "q", path)
    other = spark.createDataFrame([(1, 3, 9.0), (1, 1, 2.0), (3, 3, 5.0)], "q long, doc long, score double")
    again = runs.FullRun(docs, asked, "doc", "q", shared.scratch(spark, "full"), budget=2, rerank=lambda pool: pool.join(other, ["q", "doc"]), pool=2)
    assert [(r["q"], r["doc"], r["score"]) for r in again.reranked.orderBy("q", "rank").collect()] == [(1, 1, 2.0), (1, 2, None), (3, 1, None), (3, 2, None)]
    assert again.manifest.first()["pool"] == 2 and run.reranked is None


def test_a_release_is_whole_or_absent(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("part"), F.col("id").alias("_id"), F.concat(F.lit("line "), "id").alias("line"))
    path = shared.scratch(spark, "release")
    table, by, order = {"t": df, "n": spark.range(3).coalesce(1)}, {"t": ["part"]}, {"t": ["_id"]}
    manifest = release.publish(spark, path, table, {"note": 1}, by, order)
    assert manifest.count() == 8 and release.violations(spark, path).collect() == []
    with pytest.raises(Rejected, match="exists"):
        release.publish(spark, path, table)
    other = shared.scratch(spark, "release")
    with pytest.raises(Exception, match="planted"):
        release.publish(spark, other, {"n": spark.range(3), "t": df.select(F.when(F.col("_id") < 199, F.col("line")).otherwise(F.raise_error(F.lit("planted"))).alias("line"))})
    assert glob.glob(f"{other.removeprefix('file:')}*") == []  # nothing is left of it
    again = shared.scratch(spark, "release")
    release.publish(spark, again, table, {"note": 2}, by, order)
    ids = [spark.read.json(f"{p}/freeze/release").first()["release_id"] for p in (path, again)]
    assert ids[0] == ids[1] == release.release_id(manifest.repartition(3))
    stated = spark.read.json(f"{path}/freeze/release").coalesce(1)
    rows = stated.withColumn("release_id", F.lit("0" * 64)).collect()
    spark.createDataFrame(rows, stated.schema).coalesce(1).write.mode("overwrite").json(f"{path}/freeze/release")
    assert [r["rule"] for r in release.violations(spark, path).collect()] == ["release id"]


def test_the_hash_tree_depends_on_every_leaf(spark):
    rows = [(f"f{k}", f"{k:064x}") for k in range(3000)]
    whole = release.release_id(spark.createDataFrame(rows, "name string, sha256 string"))
    assert whole == release.release_id(spark.createDataFrame(rows[::-1], "name string, sha256 string").repartition(5))
    rows[1234] = (rows[1234][0], "0" * 64)
    assert whole != release.release_id(spark.createDataFrame(rows, "name string, sha256 string"))
    assert len(release.release_id(spark.createDataFrame([], "name string, sha256 string"))) == 64


def test_numbers_are_written_as_python_does(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1e16, 1e15, 1e-4, 1e-5, 2e-3, 1e22, 1e23, 8.41e21, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 2.0**63, -(2.0**62), 5.895534699604116e17]
    while len(xs) < 12000:
        x = struct.unpack("d", struct.pack("Q", rng.getrandbits(rng.choice([64, 64, 40]))))[0]
        xs += [x] * math.isfinite(x) + [rng.uniform(-1000, 1000), round(rng.uniform(-1e6, 1e6), rng.randrange(7)), rng.random() * 10 ** rng.randrange(-8, 20)]
    got = spark.createDataFrame(list(enumerate(xs)), "i long, x double").select("i", canonical.python_float(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [json.dumps(x) for x in xs]


def test_canonical_json_equals_pythons(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        t = "".join(rng.choice(["a", '"', "\\", "\n", "\x0b", "\x1f", "é", "😀", "/", " ", "\x7f", " "]) for _ in range(rng.randint(0, 12)))
        rows.append((i, {"z": t, "a": [None if rng.random() < 0.2 else rng.uniform(-5, 5) for _ in range(3)], "m": {t: 1, "é": None, "b": 3}, "n": None if i % 7 else {"k": True}, "y": None if i % 5 else []}))
    df = spark.createDataFrame(rows, "i long, v struct<z: string, a: array<double>, m: map<string, int>, n: struct<k: boolean>, y: array<int>>")
    for form, options in ((canonical.RETRIEVAL, {"ensure_ascii": False, "separators": (",", ":")}), (canonical.INPUT, {"ensure_ascii": False}), (canonical.RELEASE, {"separators": (",", ":")})):
        got = df.select("i", canonical.canonical(df, "v", form).alias("t")).orderBy("i").collect()
        assert [r["t"] for r in got] == [json.dumps(v, sort_keys=True, **options) for _, v in rows]
    odd = spark.createDataFrame([([1.0, float("nan")],), ([float("-inf")],), (None,)], "v array<double>")
    assert [r[0] for r in odd.select(canonical.canonical(odd, "v", canonical.RETRIEVAL)).collect()] == ["[1.0,NaN]", "[-Infinity]", "null"]
    assert [r[0] for r in odd.select(canonical.canonical(odd, "v")).collect()] == [None, None, "null"]


def test_panels_know_their_items(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "group string, item long")
    items = spark.createDataFrame([(1, {"x": ["y"]}), (2, {}), (3, None)], "item long, conditions map<string, array<string>>")
    found = {r["item"]: r["groups"] for r in panels.frozen_panel(groups, items, "item", "conditions").collect()}
    assert found == {1: ["a", "b"], 2: ["a"]}
    with pytest.raises(Rejected, match="unexpected"):
        panels.frozen_panel(groups, items.where("item > 1"), "item", "conditions")


def test_generated_cases_follow_their_recipes(spark):
    from tideline.operators import cases
    from tideline.sources import generator

    made = generator.generated_cases(spark.createDataFrame([(k, k, "s") for k in range(1, 25)], "case int, recipe int, seed string")).cache()
    assert made.count() == 24 * 42 and made.exceptAll(generator.generated_cases(spark.createDataFrame([(k, k, "s") for k in range(24, 0, -1)], "case int, recipe int, seed string").repartition(5))).count() == 0
    window = made.where("phase = 'window'")
    for a, b, metrics in ((3, 5, ("sleep",)), (21, 23, ("sleep", "activity")), (22, 24, ("rhr", "hrv")), (16, 18, ("low", "activity"))):
        for m in metrics:
            one, other = (window.where(F.col("recipe") == r).select(F.lit("w").alias("k"), m) for r in (a, b))
            assert cases.marginal_violations(one, other, ["k"], m).isEmpty(), (a, b, m)
    days = {(r["recipe"], r["n"]): r for r in made.collect()}
    assert [days[3, n]["sleep"] > 420 for n in range(28, 42)] == [True] * 7 + [False] * 7 == [days[5, n]["sleep"] < 420 for n in range(28, 42)]
    assert [days[9, n]["rhr"] for n in range(28, 42)] == [days[11, n]["rhr"] for n in range(28, 42)] and all(days[11, n]["rhr"] - days[9, n]["rhr"] == 10 for n in range(28))
    assert {n for n in range(42) if days[22, n]["rhr"] > 60 and days[22, n]["hrv"] < 30} == {32, 33, 34, 35} and not any(days[24, n]["rhr"] > 60 and days[24, n]["hrv"] < 30 for n in range(42))
    assert days[8, 36]["steps"] is None and days[8, 36]["missing"] == ["steps", "activity", "low"] and days[8, 36]["low_intervals"] == [] and days[8, 36]["wear"] == 360
    broken, long = days[18, 30], days[16, 30]
    assert len(broken["low_intervals"]) == 32 and len(broken["activity_intervals"]) == 32 and sum(e - s for s, e in broken["activity_intervals"]) == broken["activity"]
    assert [e - s for s, e in long["low_intervals"]] == [150, 160, 170] and days[17, 3]["coverage"] == 480 and days[17, 3]["sleep_start"] == 60
    for r in days.values():
        spans = sorted([*r["low_intervals"], *r["activity_intervals"]])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])), r
