"""Quality classifier with hierarchical empirical Bayes over sites.

Document evidence: a logistic regression (numpy, full batch, fixed steps) on shape features of the whole text, learned
from labelled rows: at most SAMPLE different ones (a documented bound), those under a threshold of the md5 of id and text.

Site evidence: with the host (``source``) and the path below it (here ``lang``), all documents are grouped. The mean
document probability is the global prior. How much a site can be trusted is estimated from all sites by moments: with the
variance of documents inside hosts and that between hosts, the strength of the prior is the first over the second (in
documents), and likewise for paths inside hosts (see strength). A host's posterior mean is (sum + strength * global) /
(n + strength), a path's is (sum + strength * host) / (n + strength): sparse sites shrink towards their host, and sparse
hosts towards all; where sites don't differ the strength is MOST and all shrink. The log-odds of the result are the
document's plus SITE_SHARE times the path's distance from the global prior, so a site moves documents in doubt, but no
clear one. A document is kept if the probability is at least KEEP.

Sites are summed up before the shuffle (a hot host sends one row per task), and the host and path tables meet the
documents in joins on keys with a salt of the document's row, so a hot site is spread over SALTS tasks.

Nulls: a null text counts as empty; null hosts and paths are sites of their own. Empty texts have no shape and are
rejected. Without labels of both kinds every non-empty document has the probability 0.5 and is kept. Repeated rows are
judged alike, and learned from once. An empty table gives an empty result. Other columns are ignored by ``judge`` and
kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import Settled, at_most, hashed, text_hash, unclashing
from tideline.llm.words import _tables, buffers, piece_words

SAMPLE = 20_000
STEPS, RATE, DECAY = 600, 0.1, 1e-3
SITE_SHARE, MOST = 0.5, 1e6
KEEP, SALTS = 0.5, 32
FEATURES = 9


def shape(text: bytes) -> list[float]:
    """Shares of upper case, digits, marks, marks in a row, bars, words like the one before, repeated words; length."""
    data = np.frombuffer(text, dtype=np.uint8)
    hashes, starts, ends = piece_words(data)
    n = len(hashes)
    if not n:
        return [0.0] * FEATURES
    upper = ((data >= 65) & (data <= 90)).sum()
    lower = ((data >= 97) & (data <= 122)).sum()
    mark = ((data >= 33) & (data <= 47) | (data >= 58) & (data <= 64) | (data >= 91) & (data <= 96) | (data >= 123) & (data <= 126)) & (data != 44) & (data != 46)
    double = mark[1:] & mark[:-1]
    size = (ends - starts).sum()
    again = (hashes[1:] == hashes[:-1]).sum() / n
    distinct = len(np.unique(hashes[:]))
    pairs = len(np.unique(hashes[1:] * np.uint64(31) + hashes[:-1])) if n > 1 else 1
    return [
        upper / max(1, upper + lower), ((data >= 48) & (data <= 57)).sum() / size, mark.sum() / size, double.sum() / n, (data == 124).sum() / n,
        again, 1 - min(1.0, distinct / n**0.85), 1 - pairs / max(1, n - 1), float(np.log1p(n)) / 10,
    ]


def _shapes(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns and the features; null features for empty texts."""
    import pyarrow as pa

    fields = [f for f in docs.select(columns).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["shape array<double>"])

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(len(fields)))
            rows = [shape(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(batch.num_rows)]
            out = pa.array([r if any(r) else None for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], out], [*[f.name for f in fields], "shape"])

    return docs.select(*columns, text).mapInArrow(run, schema)


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their square roots."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], axis=1)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last: bias) of a logistic regression on expanded features; the rarer class counts as much as the other."""
    x = expand(x)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w, m, v = (np.zeros(z.shape[1]) for _ in range(3))
    for t in range(1, STEPS + 1):
        g = z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def learn(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str) -> np.ndarray | None:
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key_of_row")).agg(F.max(label).alias("label_of_row"))
    rows = docs.select(F.col(key).alias("key_of_row"), text_hash(text).alias("hash_of_row"))
    rows = Settled(rows.join(known, "key_of_row").distinct(), "labelled")
    chosen = at_most(rows.df, hashed("key_of_row", "hash_of_row"), SAMPLE, rows.df.count())  # SAMPLE rows are broadcast
    texts = docs.select(F.col(key).alias("key_of_row"), text_hash(text).alias("hash_of_row"), F.col(text).alias("text_of_row"))
    texts = texts.join(F.broadcast(chosen), ["key_of_row", "hash_of_row"]).dropDuplicates(["key_of_row", "hash_of_row"])
    rows = texts.select("label_of_row", "text_of_row")
    found = _shapes(rows, ["label_of_row"], "text_of_row").where("shape IS NOT NULL").toPandas()
    y = found["label_of_row"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array(found["shape"].tolist()), y)


def strength(inside: float, between: float) -> float:
    """Documents that the prior counts for: the variance inside groups over that between them, from 1 to MOST."""
    return MOST if between <= inside / MOST else max(1.0, inside / between)


def strengths(paths: DataFrame, hosts: DataFrame) -> tuple[float, float, float]:
    """The global prior, and the strengths of a host's and a path's prior, by moments of (s, ss, n): the sum, the sum of
    squares and the number of the scores of each site.

    With groups of n scores, mean m and N scores in all: inside = sum(ss - n m^2) / (N - groups); the variance between
    groups is (sum of n (m - mean)^2 - (groups - 1) * inside) / (N - sum(n^2) / N); for paths, the mean, the 1 and the N of
    the last part are those of the host."""
    s, ss, n, k, nn, within = hosts.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).cast("double") for x in (F.col("host_s"), F.col("host_ss"), F.col("host_n"), F.lit(1), F.col("host_n").cast("double") ** 2, F.col("host_s") ** 2 / F.col("host_n"))]).first()
    if not n:
        return 0.5, MOST, MOST
    inside = max(0.0, ss - within) / max(1.0, n - k)
    of_hosts = strength(inside, (within - s * s / n - (k - 1) * inside) / max(1e-12, n - nn / n))
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"]))
    p, below, rest = both.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).cast("double") for x in (F.lit(1), F.col("s") ** 2 / F.col("n"), F.col("n").cast("double") ** 2 / F.col("host_n"))]).first()
    inside = max(0.0, ss - below) / max(1.0, n - p)
    return s / n, of_hosts, strength(inside, (below - within - (p - k) * inside) / max(1e-12, n - rest))


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", host: str = "source", path: str = "lang") -> DataFrame:
    """key, text_hash, host, path, document_score, host_posterior, path_posterior, score, kept of every row."""
    weights = learn(docs, labels, label, text, key)
    named = docs.select(F.col(key).alias("doc_id"), text_hash(text).alias("text_hash"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    shapes = _shapes(named, ["doc_id", "text_hash", "host", "path"], "text")
    if weights is None:
        logit = F.lit(0.0)
    else:
        at = lambda k: F.element_at("shape", k + 1)
        logit = F.lit(float(weights[-1]))
        for k in range(FEATURES):
            logit = logit + at(k) * float(weights[k]) + F.sqrt(F.greatest(at(k), F.lit(0.0))) * float(weights[FEATURES + k])
    clipped = F.greatest(F.least(logit, F.lit(15.0)), F.lit(-15.0))
    scores = Settled(shapes.select("doc_id", "text_hash", "host", "path", F.when(F.col("shape").isNotNull(), clipped).alias("logit")), "quality").df
    scores = scores.withColumn("document_score", F.when(F.col("logit").isNull(), 0.0).otherwise(1 / (1 + F.exp(-F.col("logit")))))

    p = F.col("document_score")
    paths = scores.groupBy("host", "path").agg(F.sum(p).alias("s"), F.sum(p * p).alias("ss"), F.count("*").alias("n"))
    paths = Settled(paths, "sites").df
    hosts = paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("ss").alias("host_ss"), F.sum("n").alias("host_n"))
    prior, host_strength, path_strength = strengths(paths, hosts)
    hosts = hosts.select(F.col("host").alias("h"), "host_s", "host_n", ((F.col("host_s") + host_strength * prior) / (F.col("host_n") + host_strength)).alias("host_posterior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("path_posterior", (F.col("s") + path_strength * F.col("host_posterior")) / (F.col("n") + path_strength)).withColumn("prior", F.lit(prior))
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_posterior", "path_posterior", (SITE_SHARE * (odds(F.col("path_posterior")) - odds(F.col("prior")))).alias("shift"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of_site"))
    salted = scores.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    both = salted.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("salt") == F.col("salt_of_site")))
    score = F.when(F.col("logit").isNull(), 0.0).otherwise(1 / (1 + F.exp(-(F.col("logit") + F.col("shift")))))
    out = both.select("doc_id", "text_hash", "host", "path", "document_score", "host_posterior", "path_posterior", score.alias("score"))
    return out.withColumn("kept", F.col("score") >= KEEP).withColumnRenamed("doc_id", key)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", **names) -> DataFrame:
    """The documents, with all their columns, that ``judge`` keeps."""
    good_key, good_hash = unclashing(docs, "good_key", "good_hash")
    good = judge(docs, labels, text=text, key=key, **names).where("kept").select(F.col(key).alias(good_key), F.col("text_hash").alias(good_hash))
    return docs.join(good, F.col(key).eqNullSafe(F.col(good_key)) & (text_hash(text) == F.col(good_hash)), "left_semi")
