"""Graded ranking metrics, summaries, paired differences, bootstrap, agreement and class scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a, b):
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def ranking_metrics(ranking: DataFrame, gold: DataFrame, run: list[str], case: str, item: str, grades: DataFrame | None = None) -> DataFrame:
    """Per run: Recall@5/10/20, strong recall@10, graded nDCG@10, irrelevant share@10. Items without a label count as 0;
    a case without positives has null recalls and nDCG, an empty ranking a null irrelevant share. Where ``grades``, the number n
    of a case's labels of each relevance, is given, ``gold`` need only hold the labels of ranked items."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    # the ideal order is told by the counts of the grades: no task sorts a case's labels
    if grades is None:
        grades = gold.groupBy(case, "relevance").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy(case).orderBy(F.desc("relevance")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = F.filter(F.sequence(F.lit(1), F.lit(10)), lambda p: (p > F.col("ahead")) & (p <= F.col("ahead") + F.col("n")))
    discount = F.aggregate(places, F.lit(0.0), lambda s, p: s + 1 / F.log2(p + 1.0))
    ideal = grades.withColumn("ahead", ahead).groupBy(case).agg(
        F.coalesce(F.sum(F.when(F.col("relevance") >= 1, F.col("n"))), F.lit(0)).alias("positives"), F.coalesce(F.sum(F.when(F.col("relevance") >= 2, F.col("n"))), F.lit(0)).alias("strong"),
        F.sum(F.coalesce(gain(F.col("relevance")), F.lit(0.0)) * discount).alias("idcg"),
    )
    hits = ranking.join(gold.select(case, item, "relevance"), [case, item], "left").withColumn("g", F.coalesce("relevance", F.lit(0)))
    within = lambda k, g: F.count_if((F.col("rank") <= k) & (F.col("g") >= g))
    per = hits.groupBy(*run).agg(
        *[within(k, 1).alias(f"hit{k}") for k in (5, 10, 20)], within(10, 2).alias("strong10"), F.count_if(F.col("rank") <= 10).alias("shown"), within(10, 1).alias("good10"),
        F.sum(F.when(F.col("rank") <= 10, gain(F.col("g")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    out = per.join(ideal, case, "left")
    return out.select(
        *run, *[ratio(F.col(f"hit{k}"), F.col("positives")).alias(f"recall{k}") for k in (5, 10, 20)], ratio(F.col("strong10"), F.col("strong")).alias("strong_recall10"),
        ratio(F.col("dcg"), F.col("idcg")).alias("ndcg10"), ratio(F.col("shown") - F.col("good10"), F.col("shown")).alias("irrelevant10"), ratio(F.least(F.lit(10), F.col("positives")), F.col("positives")).alias("recall_ceiling"),
    )


def summarize(rows: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Means and valid counts of the columns over grouping sets."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    aggs = [a for c in columns for a in (F.avg(c).alias(c), F.count(c).alias(f"{c}_valid"))]
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().cast("long").alias("grouping"), *aggs)


def pairwise_differences(rows: DataFrame, method: str, keys: list[str], value: str) -> DataFrame:
    """b - a for each two methods a < b on equal keys with both values."""
    a = rows.select(*keys, F.col(method).alias("a"), F.col(value).alias("va"))
    b = rows.select(*keys, F.col(method).alias("b"), F.col(value).alias("vb"))
    return a.join(b, keys).where("a < b AND va IS NOT NULL AND vb IS NOT NULL").select(*keys, "a", "b", (F.col("vb") - F.col("va")).alias("diff"))


def cluster_bootstrap(diffs: DataFrame, cluster: str, value: str, draws: int, seed: str) -> DataFrame:
    """Mean and 95 per cent interval: clusters are drawn with replacement by md5, values are pooled. Clusters must be few,
    as each draw takes as many of them as there are."""
    clusters = diffs.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    clusters = clusters.withColumn("k", F.row_number().over(W.orderBy(cluster)) - 1)
    n = clusters.agg(F.count("*").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"))
    grid = clusters.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(n), F.lit(True)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw", "j")), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = grid.withColumn("k", pick).join(clusters.select("k", "s", "c"), "k").groupBy("draw", "mean").agg((F.sum("s") / F.sum("c")).alias("m"))
    return drawn.groupBy("mean").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("*").alias("draws"))


def kappa(pairs: DataFrame, a: str, b: str, levels: list[int], keys: list[str] = (), weighted: bool = True) -> DataFrame:
    """n, exact agreement and (linearly weighted) kappa of two raters; null where chance alone agrees fully."""
    keys = list(keys)
    width = float(max(levels) - min(levels)) or 1.0
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    dist = (lambda x, y: F.abs(x - y) / width) if weighted else (lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
    share = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("n")).otherwise(0))
    seen = F.sum(dist(F.col("a"), F.col("b")) * F.col("n")) / F.sum("n")
    chance = sum((share("a", x) * share("b", y) * (abs(x - y) / width if weighted else float(x != y)) for x in levels for y in levels), F.lit(0.0)) / (F.sum("n") * F.sum("n"))
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("exact"), (1 - seen / F.nullif(chance, F.lit(0.0))).alias("kappa"))


def class_scores(rows: DataFrame, gold: str, predicted: str, classes: list) -> DataFrame:
    """Precision, recall and F1 of each class (0 where undefined) and the mean F1 over all classes."""
    counts = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), (F.col(gold) == c).alias("g"), (F.col(predicted) == c).alias("p")) for c in classes])).alias("x")).select("x.*")
    per = counts.groupBy("label").agg(F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("p")).alias("pp"), F.count_if(F.col("g")).alias("support"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    per = per.select("label", "support", zero(ratio(F.col("tp"), F.col("pp"))).alias("precision"), zero(ratio(F.col("tp"), F.col("support"))).alias("recall"), zero(ratio(2 * F.col("tp"), F.col("pp") + F.col("support"))).alias("f1"))
    return per.withColumn("macro_f1", F.avg("f1").over(W.partitionBy()))


def judged_metrics(ranking: DataFrame, judged: DataFrame, case: str, item: str, positive: str, negative: str) -> DataFrame:
    """Per case at 5, 10 and 20: recall of known positives, share judged, share of negatives among the judged; and nDCG@10 of
    the judged items only, moved up. ``positive`` and ``negative`` are boolean columns of ``judged``; unjudged is no negative."""
    known = judged.groupBy(case).agg(F.count_if(F.col(positive)).alias("known_positives"))
    rows = ranking.join(judged.select(case, item, positive, negative, F.lit(True).alias("_j")), [case, item], "left").withColumn("_j", F.coalesce("_j", F.lit(False)))
    place = F.row_number().over(W.partitionBy(case, "_j").orderBy("rank"))
    rows = rows.withColumn("_p", F.when(F.col("_j"), place))
    top = lambda k, c: F.count_if((F.col("rank") <= k) & c)
    aggs = [a for k in (5, 10, 20) for a in (top(k, F.col(positive)).alias(f"pos{k}"), top(k, F.col("_j")).alias(f"judged{k}"), top(k, F.col(negative)).alias(f"neg{k}"), top(k, F.lit(True)).alias(f"all{k}"))]
    per = rows.groupBy(case).agg(*aggs, F.sum(F.when(F.col(positive) & (F.col("_p") <= 10), 1 / F.log2(F.col("_p") + 1.0)).otherwise(0.0)).alias("dcg")).join(known, case, "left")
    ideal = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(10)), F.lit(1), F.least(F.lit(10), F.coalesce("known_positives", F.lit(0)).cast("int"))), F.lit(0.0), lambda a, k: a + 1 / F.log2(k + 1.0))
    out = [c for k in (5, 10, 20) for c in (ratio(F.col(f"pos{k}"), F.col("known_positives")).alias(f"known_recall{k}"), ratio(F.col(f"judged{k}"), F.col(f"all{k}")).alias(f"judged_share{k}"), ratio(F.col(f"neg{k}"), F.col(f"judged{k}")).alias(f"negative_share{k}"))]
    return per.select(case, *out, (F.col("dcg") / F.nullif(ideal, F.lit(0.0))).alias("judged_ndcg10"))


def error_rates(rows: DataFrame, gold: str, predicted: str, positive: str, unknown: str) -> DataFrame:
    """One row: share of other gold classes predicted as positive, share of wrong positives, share of unknowns found."""
    g, p = F.col(gold), F.col(predicted)
    share = lambda num, den: ratio(F.count_if(num & den), F.count_if(den))
    return rows.agg(share(p == positive, g != positive).alias("false_positive_rate"), share(g != positive, p == positive).alias("false_discovery_rate"), share(p == unknown, g == unknown).alias("unknown_found"))


def agreement_under(rows: DataFrame, a: str, b: str, filters: dict) -> DataFrame:
    """(scope, n, exact): agreement of two raters under several denominators."""
    scopes = F.explode(F.array(*[F.struct(F.lit(n).alias("scope"), F.coalesce(c, F.lit(False)).alias("_in")) for n, c in filters.items()])).alias("x")
    long = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), scopes).select("a", "b", "x.*")
    return long.groupBy("scope").agg(F.count_if(F.col("_in")).alias("n"), ratio(F.count_if(F.col("_in") & (F.col("a") == F.col("b"))), F.count_if(F.col("_in"))).alias("exact"))


def status_shares(rows: DataFrame, method: str, case: str, status: str, levels: list[str]) -> DataFrame:
    """(method, status, n, by_row, by_case): shares of all rows, and the mean of the cases' shares."""
    per = rows.groupBy(method, case).agg(F.count("*").alias("all"), *[F.count_if(F.col(status) == s).alias(f"n_{k}") for k, s in enumerate(levels)])
    long = per.select(method, "all", F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"n_{k}").alias("n")) for k, s in enumerate(levels)])).alias("x")).select(method, "all", "x.*")
    return long.groupBy(method, "status").agg(F.sum("n").alias("n"), ratio(F.sum("n"), F.sum("all")).alias("by_row"), F.avg(F.col("n") / F.col("all")).alias("by_case"))


#: Stages of a call by what its id contains, first match wins (fixed values).
CALL_STAGES = {"representations": "representations", "semantic-audit": "semantic_audit", "source.*audit|audit.*source": "source_audit", "adjudicator": "adjudication", "_P": "calibration", "judge_": "judges"}


def call_stage(task: str):
    out = None
    for pattern, stage in CALL_STAGES.items():
        hit = F.col(task).rlike(pattern)
        out = F.when(hit, stage) if out is None else out.when(hit, stage)
    return out.otherwise("other")


def call_costs(calls: DataFrame, sets: list[list[str]], prompt: str, completion: str, cached: str, price_in: float, price_out: float, discount: float) -> DataFrame:
    """Calls, tokens and cost per million tokens over grouping sets; calls without usage are counted as unknown."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    known = F.col(prompt).isNotNull() & F.col(completion).isNotNull()
    cost = ((F.col(prompt) - F.coalesce(cached, F.lit(0)) * (1 - discount)) * price_in + F.col(completion) * price_out) / 1e6
    return calls.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count("*").alias("calls"), F.count_if(~known).alias("unknown"), F.sum(F.when(known, F.col(prompt))).alias("prompt"), F.sum(F.when(known, F.col(completion))).alias("completion"), F.sum(F.when(known, cost)).alias("cost"))


def f1_bootstrap(rows: DataFrame, cluster: str, gold: str, predicted: str, classes: list, draws: int, seed: str, least: int = 8) -> DataFrame:
    """Nearest-rank 95 per cent interval of the macro F1 over clusters drawn with replacement; null with fewer than ``least``
    clusters or a class without gold. Clusters must be few (subjects), as each draw takes as many as there are."""
    cells = rows.groupBy(cluster).agg(*[F.count_if(c).alias(f"{n}{k}") for k, x in enumerate(classes) for n, c in (("t", (F.col(gold) == x) & (F.col(predicted) == x)), ("p", F.col(predicted) == x), ("g", F.col(gold) == x))])
    cells = cells.withColumn("_k", F.row_number().over(W.orderBy(cluster)) - 1)
    names = [f"{n}{k}" for k in range(len(classes)) for n in "tpg"]
    size = cells.agg(F.count("*").alias("n"), *[F.sum(f"g{k}").alias(f"all{k}") for k in range(len(classes))])  # one row
    ready = F.col("n") >= least
    for k in range(len(classes)):
        ready = ready & (F.col(f"all{k}") > 0)
    grid = cells.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(size.select("n", ready.alias("ready"))), F.lit(True)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "draw", "j")), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = grid.withColumn("_k", pick).join(cells.drop(cluster), "_k").groupBy("draw", "ready").agg(*[F.sum(n).alias(n) for n in names])
    f1 = sum((F.coalesce(ratio(2 * F.col(f"t{k}"), F.col(f"p{k}") + F.col(f"g{k}")), F.lit(0.0)) for k in range(len(classes))), F.lit(0.0)) / len(classes)
    at = lambda q: F.element_at(F.array_sort(F.collect_list("f1")), int(q * (draws - 1)) + 1)
    return drawn.select("ready", f1.alias("f1")).groupBy("ready").agg(F.count("*").alias("draws"), at(0.025).alias("low"), at(0.975).alias("high")).select("draws", F.when(F.col("ready"), F.col("low")).alias("low"), F.when(F.col("ready"), F.col("high")).alias("high"))
