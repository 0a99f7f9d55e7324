import datetime as dt
import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from tideline.functions import logic, text
from tideline.operators import checks, evaluation, intervals, retrieval, timeseries
from tideline.sources import files
from tideline.streaming.daily import daily_totals


def day(n):
    return dt.date(2024, 4, n)


def daily(spark, values, start=1):
    return spark.createDataFrame([("c", day(start + i), v) for i, v in enumerate(values)], "case string, day date, value double")


def test_missing_days_stay_missing_and_lags_follow_the_calendar(spark):
    d = daily(spark, [10.0, None, 30.0])
    row = timeseries.describe(d, ["case"]).first()
    assert (row["mean"], row["slope"], row["valid_count"], row["missing_count"]) == (20.0, 10.0, 2, 1)
    assert timeseries.lagged(d, ["case"], 1, "value", "value").count() == 0
    gap = spark.createDataFrame([("c", day(1), 1.0), ("c", day(3), 2.0), ("c", day(4), 4.0)], "case string, day date, value double")
    assert [tuple(r) for r in timeseries.lagged(gap, ["case"], 1, "value", "value").select("x", "y").collect()] == [(2.0, 4.0)]
    assert timeseries.lagged(gap, ["case"], 1, "value", "value").agg(timeseries.pearson().alias("r")).first()["r"] is None


def test_densify_and_longest_run(spark):
    d = daily(spark, [5.0, 6.0]).unionByName(daily(spark, [7.0], 4))
    assert timeseries.densify(d, ["case"], "2024-04-01", "2024-04-05").where("value IS NULL").count() == 2
    assert timeseries.longest_run(d, ["case"], F.col("value") > 1).first()["longest_run_days"] == 2


def test_circular_mean_around_midnight(spark):
    m, length = timeseries.circular(F.col("m"))
    row = spark.createDataFrame([(1430.0,), (10.0,)], "m double").agg(m.alias("m"), length.alias("r")).first()
    assert min(row["m"], 1440 - row["m"]) < 1e-6 and row["r"] > 0.99


def test_ranking_metrics_closed_form(spark):
    ranking = spark.createDataFrame([("c", "K2", 1), ("c", "K1", 2), ("c", "K3", 3), ("z", "K1", 1)], "case string, item string, rank int")
    gold = spark.createDataFrame([("c", "K1", 2), ("c", "K2", 1), ("c", "K3", 0), ("z", "K1", 0)], "case string, item string, relevance int")
    rows = {r["case"]: r for r in evaluation.ranking_metrics(ranking, gold, ["case"], "case", "item").collect()}
    assert rows["c"]["ndcg10"] == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert rows["c"]["recall10"] == rows["c"]["strong_recall10"] == 1
    assert rows["z"]["ndcg10"] is None and rows["z"]["recall10"] is None


def test_fusion_bm25_and_ties(spark):
    r = spark.createDataFrame([("q", "a", "K2", 1), ("q", "a", "K1", 2), ("q", "b", "K1", 1), ("q", "b", "K3", 2)], "run string, ranker string, item string, rank int")
    top = retrieval.rrf(r, ["run"], "item").orderBy("rank").first()
    assert top["item"] == "K1" and top["score"] == pytest.approx(1 / 62 + 1 / 61)
    docs = spark.createDataFrame([("K2", "Sleep well"), ("K1", "Activity day")], "id string, text string")
    asked = spark.createDataFrame([(1, ""), (2, "unknownterm"), (3, "sleep")], "q int, text string")
    got = sorted((x["q"], x["rank"], x["id"]) for x in retrieval.bm25(docs, asked, "id", "q").collect())
    assert got == [(2, 1, "K1"), (2, 2, "K2"), (3, 1, "K2"), (3, 2, "K1")]


def test_agreement_closed_forms(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "a int, b int")
    row = evaluation.kappa(pairs, "a", "b", [0, 1, 2]).first()
    assert (row["n"], row["exact"]) == (4, 0.5) and row["kappa"] == pytest.approx(0)
    cells = [[1592, 103, 0], [88, 365, 31], [2, 55, 68]]
    big = spark.createDataFrame([(i, j, n) for i, r in enumerate(cells) for j, n in enumerate(r) if n], "a int, b int, n int").select("a", "b", F.explode(F.sequence(F.lit(1), "n")))
    row = evaluation.kappa(big, "a", "b", [0, 1, 2]).first()
    assert row["exact"] == pytest.approx(0.87890625) and row["kappa"] == pytest.approx(0.748081498100759)
    assert evaluation.kappa(spark.createDataFrame([(0, 0)] * 3, "a int, b int"), "a", "b", [0, 1, 2]).first()["kappa"] is None


def test_bootstrap_of_one_pair(spark):
    d = spark.createDataFrame([("p", 0.2), ("p", -0.2)], "cluster string, diff double")
    row = evaluation.cluster_bootstrap(d, "cluster", "diff", 50, "1").first()
    assert (row["mean"], row["low"], row["high"]) == (0.0, 0.0, 0.0)


def test_intervals(spark):
    t = lambda h, d=1: dt.datetime(2024, 4, d, h)
    s = spark.createDataFrame([("u", 1, t(22), t(2, 2)), ("u", 2, t(5, 2), t(6, 2))], "u string, id int, start_at timestamp_ntz, end_at timestamp_ntz")
    assert sorted(r["minutes"] for r in intervals.by_day(s).collect()) == [60, 120, 120]
    other = spark.createDataFrame([("u", 9, t(1, 2), t(23, 2))], s.schema)
    assert sorted((r["left_id"], r["minutes"]) for r in intervals.overlaps(s, other, ["u"]).collect()) == [(1, 60.0), (2, 60.0)]
    assert [(r["gap_start"], r["gap_end"]) for r in intervals.gaps(s, ["u"]).collect()] == [(t(2, 2), t(5, 2))]


def test_kleene_logic(spark):
    df = spark.createDataFrame([(None, True), (False, None), (True, None), (True, False)], "p boolean, q boolean")
    tree = {"if": "p", "then": "q"}
    got = [r[0] for r in df.select(logic.applicability(logic.compile_tree(tree, F.col))).collect()]
    assert got == ["insufficient_information", "applicable", "insufficient_information", "not_applicable"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Sleep: 7 hours. Steps: 5,000 daily.",)], "t string")
    row = df.select(text.truncated(F.col("t"), 3).alias("a"), text.numbers("t").alias("n"), text.tokens("t").alias("k"), text.plain_number(F.lit(0.5)).alias("p"), text.hmac_sha256(b"key", F.col("t")).alias("h")).first()
    assert row["a"] == "Sleep: 7 hours" and row["n"] == [7.0, 5000.0] and row["p"] == "0.5"
    assert row["h"] == hmac.new(b"key", b"Sleep: 7 hours. Steps: 5,000 daily.", hashlib.sha256).hexdigest()


def test_each_check_finds_its_mutation(spark):
    good = spark.createDataFrame([("r", i + 1, f"K{i}", 5.0 - i) for i in range(3)], "run string, rank int, item string, score double")
    assert checks.ranks(good, ["run"], "item", 3).count() == 0
    found = lambda d: {r["rule"] for r in checks.ranks(d, ["run"], "item", 3).collect()}
    assert "size" in found(good.where("rank < 3"))
    assert "consecutive" in found(good.withColumn("rank", F.col("rank") + 1))
    assert "finite" in found(good.withColumn("score", F.lit(float("nan"))))
    assert "duplicate" in found(good.withColumn("item", F.lit("K0")))
    assert checks.same_values(good, good.withColumn("score", F.col("score") + 1), ["item"], "score").count() == 3
    assert checks.changed(good, good.where("rank > 1"), "item", "score").first()["change"] == "removed"


def test_files_round_trip_and_refuse(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x|y")], "a int, b string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a int, b string").count() == 2
    with pytest.raises(Exception):
        files.write_jsonl(df, str(tmp_path / "j"))
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert files.read_csv(spark, str(tmp_path / "c.csv"), "a int, b string").first()["b"] == "x"
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "c.csv"), "a int, z string")
    assert "\\|" in files.markdown(df)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("u", dt.datetime(2024, 4, 1, 5), 1.0), ("u", dt.datetime(2024, 4, 1, 9), 2.0), ("u", dt.datetime(2024, 4, 9, 9), 4.0)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp_ntz, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = daily_totals(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["user_id"])
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(60)
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert done and done <= {tuple(r) for r in daily_totals(df, ["user_id"]).collect()}
