"""Views, facts, shares and audits on small rows, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import audits, views
from tideline.sources import files


def test_view_counts_zeros_and_gaps_as_missing(spark):
    rows = [("a", 1, "rate", 0.0), ("a", 2, "rate", 60.0), ("a", 3, "rate", 64.0), ("a", 5, "rate", 62.0), ("a", 6, "rate", None)]
    long = spark.createDataFrame(rows, "user string, n int, metric string, value double")
    (got,) = views.view(long, ["user"], "statistics", 28, ("rate",)).collect()
    assert (got["n"], got["missing"], got["mean"], got["adjacent_change"], got["first_day"], got["last_day"]) == (3, 2, 62.0, 4.0, 1, 6)
    assert math.isclose(got["sd"], math.sqrt(8 / 3))
    assert views.view(long, ["user"], "current", 28).count() == 0 and views.view(long, ["user"], "full", 28).count() == 5
    with pytest.raises(ValueError):
        views.view(long, ["user"], "some", 28)


def test_query_text_writes_unknown_and_two_places(spark):
    rows = [("a", 1, "sleep_minutes", 400.0), ("a", 2, "sleep_minutes", 401.0), ("a", 29, "sleep_minutes", None)]
    long = spark.createDataFrame(rows, "user string, n int, metric string, value double")
    (got,) = views.query_text(views.view(long, ["user"], "statistics", 28), ["user"], "Open.", "Close.").collect()
    assert got["text"].split("\n") == [
        "Open.", "baseline days [1, 2]", "sleep minutes: n=2 mean=400.5 sd=0.5 slope/day=1.0", "current days [29, 29]", "sleep minutes: n=0 mean=unknown sd=unknown slope/day=unknown", "Close."]


def test_dated_keeps_the_weekday(spark):
    days = spark.createDataFrame([("a", 1, 3, -1, "23:10:00"), ("a", 2, 4, None, "01:00:00"), ("b", 1, 7, 0, None)], "user string, n int, weekday int, offset int, clock string")
    out = views.dated(days, ["user"]).withColumn("at", views.clock_at(F.col("date"), F.col("offset"), F.col("clock")).cast("string"))
    got = [(str(x["date"]), x["at"], x["weekday"] == x["date"].isoweekday()) for x in out.orderBy("user", "n").collect()]
    assert got == [("2000-01-05", "2000-01-04 23:10:00", True), ("2000-01-06", None, True), ("2000-01-09", None, True)]


def test_shares_are_null_until_all_cases_are_resolved_and_without_cases(spark):
    schema = "case_id long, priority string, top_outcome string, items array<string>, pairs array<string>"
    rows = [(1, "clear", "unique_best", ["applicable", "applicable"], ["tie"]), (2, "clear", "insufficient_information", ["applicable"], [])]
    resolved, cases = spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (2,)], "case_id long")
    (got,) = views.descriptive(cases, resolved).collect()
    assert tuple(got) == (2, 0, 0.5, 1, 1.0, 0.5, 0.5, 0.5)
    (got,) = views.descriptive(cases.unionByName(spark.createDataFrame([(3,)], "case_id long")), resolved).collect()
    assert tuple(got) == (3, 1, None, None, None, None, None, None)
    (got,) = views.descriptive(cases.where("false"), resolved).collect()
    assert tuple(got) == (0, 0, None, 0, None, None, None, None)


def test_facts_of_a_month_without_values_are_none(spark):
    long = spark.createDataFrame([("a", n, "value", None) for n in range(1, 31)], "user string, n int, metric string, value double")
    empty = spark.createDataFrame([], "user string, n int, metric string, minute double, minutes double")
    assert views.facts(long, empty, empty, empty, ["user"], 17, 7, F.col("n") % 7 >= 5, "value", "value", "value").count() == 0


def test_source_audit_takes_nulls_as_faults(spark):
    checked = spark.createDataFrame([("s", "c", None, None, None, None)], "source_id string, condition_id string, original_text string, role string, support string, evidence array<struct<paragraph_id:string,quote:string>>")
    expected = spark.createDataFrame([("s", "c", "must")], "source_id string, condition_id string, text string")
    found = audits.sources(checked, expected, expected.selectExpr("source_id", "'p' AS paragraph_id", "text"))
    assert sorted(x["rule"] for x in found.collect()) == ["evidence", "role", "support", "text"]


def test_rounds_without_records_are_incomplete(spark):
    plan = spark.createDataFrame([("x", 1), ("y", 1)], "round string, expected long")
    got = audits.rounds(spark.createDataFrame([("x", 7), ("x", 7)], "round string, item long"), plan, ["round"], "item").collect()
    assert [tuple(x) for x in got] == [("round", "y", "0 of 1")]


def test_json_document_is_exclusive_and_finite(spark, tmp_path):
    path = str(tmp_path / "manifest.json")
    files.write_json(spark, path, {"n": 1, "t": "ü"})
    assert open(path, encoding="utf-8").read() == '{\n  "n": 1,\n  "t": "ü"\n}\n'
    with pytest.raises(ValueError):
        files.write_json(spark, path, {})
    files.write_json(spark, path, [], overwrite=True)
    assert files.read_json(spark, path).count() == 0
    with pytest.raises(ValueError):
        files.write_json(spark, str(tmp_path / "other.json"), float("nan"))
