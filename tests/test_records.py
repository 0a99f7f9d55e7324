import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import budget, pages
from tideline.operators import cases, evaluation, judging, records, retrieval
from tideline.plans import record_queries
from tideline.sources import records as imports


def t(h, m=0, d=2):
    return dt.datetime(2024, 4, d, h, m)


def day(n):
    return dt.date(2024, 4, n)


# --- partial orders -------------------------------------------------------------------------------------------------------


def implied(items, pairs):
    """Whether some ranking with ties and gaps fits: by trying all chains, in plain Python."""
    better, equal = set(), {(x, x) for x in items}
    for a, b, q in pairs:
        if q == "left_preferred":
            better.add((a, b))
        elif q == "right_preferred":
            better.add((b, a))
        elif q == "tie":
            equal |= {(a, b), (b, a)}
    changed = True
    while changed:
        new = {(a, d) for a, b in equal for c, d in equal if b == c} - equal
        more = {(a, d) for a, b in equal | better for c, d in equal | better if b == c and ((a, b) in better or (c, d) in better)} - better
        equal |= new
        better |= more
        changed = bool(new or more)
    return better, equal


def test_preferences_equal_plain_closure():
    rng = random.Random(4)
    seen = set()
    for _ in range(600):
        n = rng.randint(1, 5)
        items = [f"i{k}" for k in range(n)]
        level = {x: rng.randint(0, 2) for x in items}
        pairs = []
        for a, b in itertools.combinations(items, 2):
            true = "tie" if level[a] == level[b] else "left_preferred" if level[a] > level[b] else "right_preferred"
            pairs.append((a, b, rng.choice(judging.RELATIONS) if rng.random() < 0.2 else true))
        bad, priority, top, best = judging.preference(items, pairs)
        better, equal = implied(items, pairs)
        wrong = any((b, a) in better or (a, b) in equal for a, b in better)
        for a, b, q in pairs:
            if (a, b) in equal and q != "tie" or (a, b) in better and q != "left_preferred" or (b, a) in better and q != "right_preferred":
                wrong = True
        assert bool(bad) == wrong
        if not wrong and n > 1:
            assert best == [x for x in items if all((x, y) in equal or (x, y) in better for y in items)]
        seen.add((priority, top))
    assert {("clear", "unique_best"), ("none", "tied_best"), ("not_comparable", "not_comparable")} <= seen
    assert judging.preference(["a", "b"], [])[0] == ["missing pair"]
    assert judging.preference(["a", "b"], [("a", "b", "incomparable")])[1:] == ("none", "undetermined", [])
    assert judging.preference(["a", "b"], [("a", "b", "insufficient_information")])[1:] == ("insufficient_information", "insufficient_information", [])


def test_preferences_of_cards(spark):
    items = spark.createDataFrame([(1, "x", "applicable"), (1, "y", "applicable"), (2, "x", "applicable"), (2, "y", "applicable"), (2, "z", "insufficient_information"), (3, "x", "not_applicable")], "c int, item string, applicability string")
    pairs = spark.createDataFrame([(1, "x", "y", "left_preferred"), (2, "x", "y", "tie")], "c int, left string, right string, relation string")
    got = {r["c"]: r for r in judging.preferences(items, pairs, "c").collect()}
    assert got[1]["best_set"] == ["x"] and got[1]["top_outcome"] == "unique_best" and got[2]["top_outcome"] == "insufficient_information" and got[3]["applicable"] == 0


# --- case rules -----------------------------------------------------------------------------------------------------------


DAILY = "case string, day date, wear double, night_coverage double, steps int, activity_duration_minutes double, low_movement_minutes double, sleep_duration_minutes double, resting_heart_rate_bpm double, hrv_rmssd_ms double, missing map<string,string>"
SPAN = "case string, id int, day date, kind string, start_at timestamp_ntz, end_at timestamp_ntz"


def case(spark, daily=None, spans=(), sleeps=None):
    row = ["c", day(2), 800.0, 420.0, 5000, 60.0, 30.0, 400.0, 60.0, 40.0, {}]
    for k, v in (daily or {}).items():
        row[DAILY.split(", ").index(next(f for f in DAILY.split(", ") if f.startswith(k + " ")))] = v
    intervals = spans or [("c", 1, day(2), "activity", t(10), t(11)), ("c", 2, day(2), "low_movement", t(12), t(12, 30))]
    nights = sleeps or [("c", 9, day(2), "sleep", t(23, 0, 1), t(6, 30))]
    return spark.createDataFrame([tuple(row)], DAILY), spark.createDataFrame(intervals, SPAN), spark.createDataFrame(nights, SPAN)


def found(spark, **changes):
    d, i, s = case(spark, **changes)
    return {r["rule"] for r in cases.metric_violations(d, s).unionByName(cases.interval_violations(d, i, s)).select("rule").distinct().collect()}


def test_each_case_rule_finds_its_mutation(spark):
    assert found(spark) == set()
    assert found(spark, daily={"steps": None}) == {"reasons"}
    assert found(spark, daily={"wear": 700.0}) == {"wear"}
    assert found(spark, daily={"night_coverage": 170.0}) == {"night"}
    assert found(spark, daily={"sleep_duration_minutes": 500.0}) == {"sleep length"}
    assert found(spark, daily={"wear": 1300.0}) == {"natural day"}
    assert found(spark, daily={"hrv_rmssd_ms": float("inf")}) == {"finite"}
    assert "wake date" in found(spark, sleeps=[("c", 9, day(2), "sleep", t(20, 0, 1), t(23, 30, 1))])
    assert "activity sum" in found(spark, spans=[("c", 1, day(2), "activity", t(10), t(11, 1)), ("c", 2, day(2), "low_movement", t(12), t(12, 30))])
    assert "day overlap" in found(spark, spans=[("c", 1, day(2), "activity", t(10), t(11)), ("c", 2, day(2), "low_movement", t(10, 30), t(11))])
    assert "day and night" in found(spark, spans=[("c", 1, day(2), "activity", t(6), t(7)), ("c", 2, day(2), "low_movement", t(12), t(12, 30))])
    assert "bounds" in found(spark, spans=[("c", 1, day(2), "activity", t(23, 30), t(0, 30, 3)), ("c", 2, day(2), "low_movement", t(12), t(12, 30))])


def test_pair_rules(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2)], "k string, v int")
    assert cases.marginal_violations(a, a.orderBy(F.desc("v")), ["k"], "v").count() == 0
    assert {r["key"] for r in cases.marginal_violations(a, a.distinct(), ["k"], "v").collect()} == {"p|2"}
    s = spark.createDataFrame([("u", 1, t(8), t(9)), ("u", 2, t(10), t(11)), ("u", 3, t(12), t(13))], "u string, id int, start_at timestamp_ntz, end_at timestamp_ntz")
    inner = spark.createDataFrame([("u", 7, t(9, 10), t(9, 20)), ("u", 8, t(11, 50), t(12, 5))], s.schema)
    assert [r["gap_start"] for r in cases.gaps_without(s, inner, ["u"]).collect()] == [t(11)]
    d = spark.createDataFrame([("c", day(2), 300.0), ("c", day(3), 400.0)], "case string, day date, v double")
    i = spark.createDataFrame([("c", day(1), t(20, 0, 1), t(21, 30, 1)), ("c", day(2), t(21), t(23)), ("c", day(9), t(20, 0, 9), t(20, 30, 9))], "case string, day date, start_at timestamp_ntz, end_at timestamp_ntz")
    row = cases.exposures(d, i, "v", 350.0).first()
    assert (row["exposed"], row["followed"]) == (2, 1)
    stages = {"a": cases.marginal_violations(a, a.distinct(), ["k"], "v"), "b": cases.marginal_violations(a, a, ["k"], "v")}
    assert [tuple(r) for r in cases.overview(stages).collect()] == [("a", "multiset", 1)]


# --- records --------------------------------------------------------------------------------------------------------------


def test_paths_fences_and_masks(spark):
    df = spark.createDataFrame([('{"a":{"0":null,"b":[1,{"c":"x"}]}}',), ("no json",), (None,)], "j string")
    cols = [c for p in ("a.b.1.c", "a.z") for c in records.at_path(F.col("j"), p)]
    got = [tuple(r) for r in df.select(*[c.alias(str(k)) for k, c in enumerate(cols)]).collect()]
    assert got == [("x", "found", None, "absent"), (None, "absent", None, "absent"), (None, "absent", None, "absent")]
    null = spark.createDataFrame([('{"a":null}',)], "j string").select(records.at_path(F.col("j"), "a")[1].alias("s")).first()["s"]
    assert null == "null"
    arrays = spark.createDataFrame([('["x","y"]',), ('{"a":1}',), ("x",)], "j string").select(records.decoded_array(F.col("j")).alias("x")).collect()
    assert [r["x"] for r in arrays] == [["x", "y"], None, None]
    nested = spark.createDataFrame([((["key 12"], {"k": "key 3"}), 5)], "s struct<a array<string>, m map<string,string>>, n int".replace("a array", "a: array").replace("m map", "m: map"))
    row = records.masked(nested, "key", "*").first()
    assert row["s"]["a"] == ["* 12"] and row["s"]["m"] == {"k": "* 3"} and row["n"] == 5
    assert records.without_fields(nested, "s", ["m"]).schema["s"].dataType.names == ["a"]


def test_placeholders_and_citations(spark):
    answers = spark.createDataFrame([("a", "yes"), ("b", None)], "k string, v string")
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {tuple(r) for r in records.with_placeholders(answers, want, ["k"], {"v": "omitted"}).collect()} == {("a", "yes"), ("b", "omitted"), ("c", "omitted")}
    df = spark.createDataFrame([(["k.0"], ["d1.x"], ["k.0", "z.9"], "applicable", []), (["k.0"], [], ["k.0"], "insufficient_information", [])], "known array<string>, o array<string>, c array<string>, l string, m array<string>")
    got = [r["e"] for r in df.select(judging.citation_errors(*[F.col(x) for x in ("known", "o", "c", "l", "m")]).alias("e")).collect()]
    assert got == [["UNKNOWN_CONDITION"], ["NO_MISSING_INFORMATION"]]


def test_bisection_equals_recursion():
    def plain(a, b, sizes):
        return [(a, b)] if b - a <= 1 or sum(sizes[a:b]) <= 30 else plain(a, (a + b) // 2, sizes) + plain((a + b) // 2, b, sizes)

    rng = random.Random(5)
    for n in range(1, 40):
        sizes = [rng.randint(0, 40) for _ in range(n)]
        assert list(records.halves(sizes, 30)) == plain(0, n, sizes)


def test_gates(spark):
    m, none = spark.createDataFrame([("a", 0.5)], "k string, v double"), spark.createDataFrame([], "x int")
    assert tuple(judging.gated(m, none, ["v"]).first()) == ("a", None, "PENDING")
    assert tuple(judging.gated(m, m, ["v"]).first()) == ("a", 0.5, "READY")


def test_f1_bootstrap_needs_subjects(spark):
    rows = spark.createDataFrame([(s, c, c) for s in range(8) for c in (0, 1, 2)], "s int, g int, p int")
    assert tuple(evaluation.f1_bootstrap(rows, "s", "g", "p", [0, 1, 2], 20, "1").first()) == (20, 1.0, 1.0)
    assert tuple(evaluation.f1_bootstrap(rows.where("s < 7"), "s", "g", "p", [0, 1, 2], 20, "1").first()) == (20, None, None)


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("red green blue the of sky sea sun moon star".split()) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    got = {(r["left_id"], r["right_id"]): r["jaccard"] for r in retrieval.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, x string"), "id", "x", 0.28).collect()}
    sets = [set(x.split()) - set(retrieval.STOP_WORDS) for x in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(60) for b in range(a + 1, 60) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.28 * len(sets[a] | sets[b])}
    assert got == pytest.approx(want)


# --- imports --------------------------------------------------------------------------------------------------------------


def test_daily_metric_and_merge(spark):
    raw = spark.createDataFrame([("2024-04-01 00:00:00", "12"), ("2024-04-02", '{"value": 61.5}'), ("2024-04-03", None)], "dateTime string, value string")
    got = imports.daily_metric(raw, 300)
    assert [(r["day"], r["value"]) for r in got.orderBy("day").collect()] == [(day(1), 12.0), (day(2), 61.5), (day(3), None)]
    with pytest.raises(imports.Rejected):
        imports.daily_metric(raw.union(raw))
    with pytest.raises(imports.Rejected):
        imports.daily_metric(spark.createDataFrame([("2024-04-01", "-1")], raw.schema))
    other = got.where("value = 12").unionByName(spark.createDataFrame([(day(9), 5.0)], "day date, value double"))
    rows = {r["day"]: (r["a"], r["b"]) for r in imports.merged({"a": got, "b": other}, ["day"]).collect()}
    assert rows == {day(1): (12.0, 12.0), day(2): (61.5, None), day(3): (None, None), day(9): (None, 5.0)}


def test_main_sleep(spark):
    schema = "logId long, dateOfSleep string, startTime string, endTime string, mainSleep boolean, minutesAsleep int, timeInBed int, type string, infoCode int"
    a = (1, "2024-04-02", "2024-04-01T23:10:00", "2024-04-02T06:00:00", True, 380, 410, "stages", 0)
    b = (2, "2024-04-03", "2024-04-03T00:10:00", "2024-04-03T06:00:00", True, 300, 350, None, None)
    logs = spark.createDataFrame([a, a, b, (3, *b[1:5], 301, *b[6:]), (4, "2024-04-04", *b[2:4], None, 300, 350, None, None)], schema)
    got = {r["day"]: r for r in imports.main_sleep(logs).collect()}
    assert set(got) == {day(2), day(3)}
    assert got[day(2)]["flag"] == "repeated" and got[day(2)]["start_day_offset"] == -1 and got[day(2)]["start_clock"] == "23:10:00"
    assert got[day(3)]["flag"] == "conflict" and got[day(3)]["sleep_minutes"] is None
    with pytest.raises(imports.Rejected):
        imports.main_sleep(spark.createDataFrame([(*a[:7], "odd", 0)], schema))


def test_gold_and_exports(spark):
    expected = spark.createDataFrame([("c", "k1"), ("c", "k2")], "c string, k string")
    good = spark.createDataFrame([("c", "k1", 0, "x"), ("c", "k2", 2, "x")], "c string, k string, r int, label_kind string")
    assert imports.gold(good, expected, ["c", "k"], "r", "x").count() == 2
    for bad in (good.limit(1), good.union(good), good.withColumn("r", F.lit(3)), good.withColumn("label_kind", F.lit("y"))):
        with pytest.raises(imports.Rejected):
            imports.gold(bad, expected, ["c", "k"], "r", "x")
    cards = spark.createDataFrame([("A", "1"), ("A", "2")], "reviewer_id string, case_ref string")
    assert imports.reviewer_exports(cards).count() == 2
    for bad in (cards.limit(0), cards.union(cards), cards.union(spark.createDataFrame([("B", "3")], cards.schema))):
        with pytest.raises(imports.Rejected):
            imports.reviewer_exports(bad)


def test_stored_results_and_inventory(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("a", [0.6, 0.8])], "id string, embedding array<float>")

    items = spark.createDataFrame([("a", "text")], "id string, text string")
    for _ in range(2):
        assert imports.vector_cache(spark, str(tmp_path / "v"), items, "model-1", make).count() == 1
    assert len(made) == 1
    with pytest.raises(imports.Rejected):
        imports.vector_cache(spark, str(tmp_path / "v"), items, "model-2", lambda: make().withColumn("embedding", F.expr("array(1f, 1f)")))
    (tmp_path / "f").mkdir()
    for n in ("a.json", "b.json"):
        (tmp_path / "f" / n).write_text("{}")
    want = spark.createDataFrame([("a",), ("c",)], "name string")
    assert {(r["rule"], r["key"]) for r in imports.inventory(spark, str(tmp_path / "f"), want).collect()} == {("missing", "c"), ("unexpected", "b")}


def test_generated_series_and_stages(spark):
    assert imports.calibration_series(spark, "2024-04-01").where("steps IS NULL").select("series").distinct().count() == 1
    g = imports.generated_days(spark, 4, 14, "s1")
    assert g.exceptAll(imports.generated_days(spark, 4, 14, "s1")).count() == 0
    assert cases.marginal_violations(g.where("case = 0").drop("case"), g.where("case = 1").drop("case"), [], "steps").count() == 0
    ran = []
    imports.run_stages([(n, lambda n=n: ran.append(n)) for n in "abcd"], "b", "c")
    assert ran == ["b", "c"]
    with pytest.raises(ValueError):
        imports.run_stages([("a", print), ("b", print)], "b", "a")


# --- pages and budgets ----------------------------------------------------------------------------------------------------


PAGE = "<html><body><nav><p>Navigation text here</p></nav><main><h2>The heading line</h2><p>A paragraph &amp; more text</p><ul><li><p>Item that is nested inside</p></li><li>short</li></ul><p>A paragraph &amp; more text</p><table><tr><td>cell one text</td><td>two</td></tr></table></main><p>Outside of the main part</p><script>var x = '<p>script text here</p>'</script></body></html>"


def test_page_text(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain text without any markup"), (5, "<div>a  b<style>x{}</style><p>c &lt; d<br>e</div>\n\n f")], "page_id int, html string")
    assert sorted(tuple(r) for r in pages.page_paragraphs(df).collect()) == [(1, "P0001", "The heading line", "The heading line"), (1, "P0002", "The heading line", "A paragraph & more text"), (1, "P0003", "The heading line", "Item that is nested inside"), (1, "P0004", "The heading line", "cell one text two")]
    lines = {r["page_id"]: r["text"] for r in pages.page_lines(df).collect()}
    assert lines[2] == lines[3] == "" and lines[4] == "plain text without any markup" and lines[5] == "a b\nc < de\nf"


def test_paragraphs_of_the_first_region_and_with_their_last_heading(spark):
    page = """<body><p>Not in the region at all</p><div role=main><article><h2>Head</h2><p>First paragraph of it<p>Second paragraph of it
    <ul><li>An item with <b>bold</b> words<li>Another item here</ul></i><h3></h3><p>After an empty heading</p></article></div><article><p>In the second article</p></article>"""
    got = [tuple(r)[1:] for r in pages.page_paragraphs(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("paragraph_id").collect()]
    assert got == [("P0001", "Head", "First paragraph of it"), ("P0002", "Head", "Second paragraph of it An item with bold words Another item here"), ("P0003", "Head", "An item with bold words"), ("P0004", "Head", "Another item here"), ("P0005", "", "After an empty heading")]


class Letters:
    """One token per character."""

    def encode_ordinary(self, text):
        return [ord(c) for c in text]

    def decode(self, tokens):
        return "".join(map(chr, tokens))


def test_budgets():
    assert budget.cut("abc def", 4, Letters()) == ("abc", 7, True) and budget.cut(" abc ", 9, Letters()) == ("abc", 5, False)
    rng = random.Random(7)
    for _ in range(100):
        slots = ["x" * rng.randint(0, 12) for _ in range(5)]
        limit = rng.randint(4, 50)
        got, before, was = budget.cut_slots(slots, limit, Letters())
        want = list(slots)
        while len("\n".join(want)) > limit:
            k = max(range(5), key=lambda i: (len(want[i]), -i))
            want[k] = want[k][:-1]
        assert got == want and before == len("\n".join(slots)) and was == (before > limit)


def test_preference_cards_hold_all_parts_of_a_supplier(spark):
    d = "/root/testdata/sf0.001"
    want = {r[0]: r[1] for r in spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(F.countDistinct("l_partkey")).collect()}
    got: dict = {}
    for r in record_queries.preference_outcomes(spark, d).collect():
        assert 1 <= r["applicable"] <= 10
        got[r["l_suppkey"]] = got.get(r["l_suppkey"], 0) + r["applicable"]
    assert got == want
