"""Aliases, packing, snapshots, newer rules and assembled records against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import aliases, packing, snapshots


def test_only_proven_aliases_are_written(spark):
    proofs = spark.createDataFrame([("s", "a.1", "x"), ("s", "a.1", "x"), ("s", "a.2", "y"), ("s", "a.3", "z"), ("s", "a.4", "z"), ("t", "a.1", "u"), ("t", "a.1", "v"), (None, "a.1", "w"), ("s", None, "q")], "scope string, alias string, target string")
    faults = {(r["scope"], r["alias"]): r["fault"] for r in aliases.proven(proofs, "scope", "alias", "target").collect()}
    assert faults == {("s", "a.1"): None, ("s", "a.2"): None, ("s", "a.3"): "shared target", ("s", "a.4"): "shared target", ("t", "a.1"): "ambiguous alias"}
    schema = "id int, scope string, record struct<refs: array<string>, deep: array<struct<ref: string, kept: string, more: struct<ref: string>>>, note: string>"
    rows = [(1, "s", (["a.1", "other"], [("a.2", "a.1", ("a.1",))], "a.1")), (2, "s", (["a.1", "a.3"], None, None)), (3, "t", (["a.1"], [], "n")), (4, "none", (["fixed"], None, None)), (5, "s", None), (6, "s", ([None, "a.2"], [None], "n"))]
    got = {r["id"]: r for r in aliases.rewritten(spark.createDataFrame(rows, schema), "scope", "record", ["refs", "ref"], r"^a\.\d+$", proofs, "alias", "target").collect()}
    assert got[1]["record"].asDict(True) == {"refs": ["x", "other"], "deep": [{"ref": "y", "kept": "a.1", "more": {"ref": "x"}}], "note": "a.1"} and got[1]["unproven"] == []
    assert got[2]["record"]["refs"] == ["a.1", "a.3"] and got[2]["unproven"] == ["a.3"] and got[3]["unproven"] == ["a.1"]
    assert got[4]["unproven"] == [] and got[5]["record"] is None and got[6]["record"]["refs"] == [None, "y"]
    with pytest.raises(ValueError, match="none of the fields"):
        aliases.rewritten(spark.createDataFrame(rows, schema), "scope", "record", ["absent"], "x", proofs, "alias", "target")


def test_next_fit_in_parts_is_the_fold(spark):
    rng = random.Random(4)
    for sizes in ([0, 0, 11, 0, 3], [5] * 40, [rng.choice([0, 1, 2, 9, 30]) for _ in range(3000)], [rng.randrange(4) for _ in range(2000)]):
        rows = [(rng.choice(["a", "b"]) if k % 3 else "a", k, s if s or k % 2 else None) for k, s in enumerate(sizes)]
        df = spark.createDataFrame(rows, "scope string, k int, size int").repartition(6)
        got = {(r["scope"], r["k"]): r["batch"] for r in packing.next_fit(df, "scope", ["k"], "size", 10).collect()}
        for scope in "ab":
            batch, fill = -1, 0
            for _, k, s in [r for r in rows if r[0] == scope]:
                s = s or 0
                if batch < 0 or fill + s > 10:
                    batch, fill = batch + 1, s
                else:
                    fill += s
                assert got[scope, k] == batch, (scope, k)


def test_the_best_snapshot_before(spark):
    rng, kinds = random.Random(5), ["first", "second"]
    known = [("hot" if rng.random() < 0.6 else rng.choice("xyz"), rng.randrange(500), rng.choice([*kinds, "never"]), i) for i in range(300)]
    asked = [(rng.choice(["hot", "x", "y", "none"]), rng.randrange(-20, 520), i) for i in range(200)]
    got = snapshots.best_before(spark.createDataFrame(asked, "key string, at int, id int"), spark.createDataFrame(known, "key string, at int, kind string, number int"), "key", "at", "kind", kinds, ["number"], width=16)
    found = {r["id"]: (r["kind"], r["number"]) for r in got.collect()}
    assert len(found) == 200
    for key, at, i in asked:
        want = next(((kind, best[1]) for kind in kinds if (best := max(((t, n) for k, t, c, n in known if k == key and c == kind and t <= at), default=None))), (None, None))
        assert found[i] == want


def test_newer_rules_twice_are_once(spark):
    stored = spark.createDataFrame([(1, 5, ["old"], False, 1, "keep"), (2, None, [], True, 1, "keep"), (3, -1, [], True, 3, "keep"), (4, -1, None, None, None, None)], "id int, x int, errors array<string>, usable boolean, validator_version int, label string")
    once = snapshots.revalidated(stored, 2, {"known": F.col("x").isNotNull(), "positive": F.col("x") > 0})
    assert [tuple(r) for r in once.orderBy("id").collect()] == [(1, 5, [], True, 2, "keep"), (2, None, ["known", "positive"], False, 2, "keep"), (3, -1, [], True, 3, "keep"), (4, -1, ["positive"], False, 2, None)]
    assert snapshots.revalidated(once, 2, {"never": F.lit(False)}).exceptAll(once).count() == 0


def test_records_are_assembled_by_one_shuffle(spark):
    a = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "case int, k int, v string")
    b = spark.createDataFrame([(1, 0.5), (3, None)], "case int, score double")
    whole = snapshots.assembled({"rows": (a, ["k"]), "scores": (b, [])}, "case")
    got = {r["case"]: ([(x["k"], x["v"]) for x in r["rows"]], [x["score"] for x in r["scores"]]) for r in whole.collect()}
    assert got == {1: ([(1, "a"), (2, "b")], [0.5]), 2: ([(1, "c")], []), 3: ([], [None])}
    plan = whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
