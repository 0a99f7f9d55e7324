"""Rules that the tables can't show: short passages, rosters, retrieval runs that were changed."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import runs, values
from tideline.plans import queries


def test_short_passages_are_found(spark, tmp_path):
    texts = ["a cat sat on the mat", "concatenation of lines", "the dog ran far away today", "", None]
    items = ["cat", "cat sat", "cat sat on", "a cat sat on", "the dog ran far away", "no such words here at all", "ran far away tod"]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.item_id, r.doc_id) for r in queries.QUERIES["quote_containment"](spark, str(tmp_path)).collect()}
    assert found == {(i, k) for i, item in enumerate(items) for k, t in enumerate(texts) if t is not None and item in t}


ROSTER = [("A", "p1", "reviewer", "sleep", True, True, True), ("B", "p2", "reviewer", "sport", True, True, False), ("C", "p3", "adjudicator", "heart", True, True, True)]


@pytest.mark.parametrize("change, rule", [
    (None, None), ((1, 1, "p1"), "duplicate"), ((0, 6, False), "expertise"), ((2, 6, False), "adjudicator"), ((2, 2, "reviewer"), "role"),
    ((1, 4, False), "human"), ((1, 3, " "), "person"), ((2, 0, "D"), "reviewer"), ((0, 5, None), "human"),
])
def test_roster(spark, change, rule):
    rows = [list(r) for r in ROSTER]
    if change:
        rows[change[0]][change[1]] = change[2]
    people = spark.createDataFrame([tuple(r) for r in rows], "reviewer_id string, person_id string, role string, background string, is_human boolean, independent boolean, qualified boolean")
    rules = {r.rule for r in values.roster_violations(people).collect()}
    assert rules == set() if rule is None else rule in rules


def test_a_changed_run_is_found(spark):
    docs = spark.createDataFrame([("K1", "sleep well at night"), ("K2", "steps by day"), ("K3", "heart rate at rest")], "id string, text string")
    slots = spark.createDataFrame([("C1", 0, "sleep at night"), ("C1", 1, "steps"), ("C2", 0, "heart rate")], "case string, slot int, text string")
    run = runs.run(docs, slots, "id", "case", k=3).cache()
    assert run.where("rank = 1 AND case = 'C2'").first()["id"] == "K3"
    assert runs.violations(run, run, "case", "id", k=3).isEmpty()
    moved = run.withColumn("score", F.col("score") + F.when((F.col("case") == "C2") & (F.col("rank") == 1), 0.5).otherwise(0))
    assert [(r.rule, r.key) for r in runs.violations(moved, run, "case", "id", k=3).collect()] == [("value", "C2|1|K3")]
    assert {r.rule for r in runs.violations(run.where("rank <> 2"), run, "case", "id", k=3).collect()} == {"size", "consecutive", "value"}


def test_contained_paths():
    assert values.contained("/data", "a/b") == "/data/a/b"
    for path in ("../x", "/etc/x", "a/../../data2/x"):
        with pytest.raises(ValueError):
            values.contained("/data", path)


def test_documents_are_compared_at_any_depth(spark):
    deep = lambda x, n: '{"a": ' * n + x + "}" * n
    rows = [
        (1, deep("1.0", 12), deep("1.00000000001", 12)), (2, deep("1.0", 12), deep("1.1", 12)), (3, '{"a.b": 1, "a": {"b": 2}}', '{"a.b": 1, "a": {"b": 2}}'),
        (4, '{"a,b": 1}', '{"a": 1, "b": 2}'), (5, '{"0": {"x": 1}}', '[{"x": 1}]'), (6, "[]", "{}"), (7, '{"a": [1, [2, [3]]]}', '{"a": [1, [2, [3, 4]]]}'), (8, "{", "{}"), (9, "null", "null"), (10, None, '"x"'),
    ]
    found = {(r["id"], r["path"], r["fault"]) for r in values.compared(spark.createDataFrame(rows, "id int, actual string, expected string"), ["id"], "actual", "expected").collect()}
    assert found == {(2, ".".join(["$", *"a" * 12]), "value"), (4, "$", "fields"), (5, "$", "length"), (6, "$", "fields"), (7, "$.a.1.1", "length"), (8, "$", "fields"), (10, "$", "value")}
