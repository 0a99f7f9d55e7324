"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Learned from bounded samples (documented bounds): at most POSITIVES different confirmed toxic rows and UNLABELLED different
rows whose labels, if there are any, aren't looked at; in both cases those under a threshold of the md5 of id and text. The class prior is the share of
toxic rows among all labelled training rows. The risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  is minimised
with the sigmoid loss; where its second part falls under 0, that part's gradient is reversed (non-negative correction).

A text's inputs are the distinct hashed pieces of its words (A-Z lower-cased): whole words, and their first and last
SIZES bytes. A piece counts once however often it occurs. Of the CANDIDATES pieces that most positives have, the PIECES
most unevenly spread between positives and unlabelled texts get weights, if the log-likelihood ratio is at least GAIN
and, by the prior, at least PURITY of the unlabelled texts with the piece are toxic. The score is the
logistic function of the bias and the weights of the text's pieces.

Scores use the text alone. Nulls: a null text counts as empty and gets the score of the bias; a null id counts as the
text '' for the fold, and labels with a null id are left out. Repeated label rows of an id: toxic if any says so.
Without toxic rows to learn from all scores are 0. Ties of the samples: by id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import Settled, at_most, crc_mod, hashed, text_hash
from tideline.llm.words import _tables, buffers, cuts, runs

POSITIVES, UNLABELLED = 5_000, 15_000
SIZES = (3, 4, 5, 6, 7, 8, 9)
CANDIDATES, PIECES = 1 << 16, 1 << 11
GAIN, PURITY = 7.0, 0.5
STEPS, RATE, DECAY, BIAS = 300, 0.05, 1e-6, 4.0
_BITS = 20


def pieces(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row of each piece, hash of each piece) of an Arrow column, with repetitions.

    A row longer than PIECE is cut at white space, so its words stay whole."""
    data, offsets = buffers(column)
    for a, b in runs(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a == 1:
            parts = [(data[lo + s : lo + e], np.zeros(2, int)) for s, e in cuts(data[lo:hi], _tables(1)[1])]
        else:
            own = offsets[a : b + 1] - lo + np.arange(b - a + 1)
            joined = np.full(hi - lo + b - a, 32, dtype=np.uint8)
            joined[np.arange(hi - lo) + np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))] = data[lo:hi]
            parts = [(joined, own)]
        found = [_pieces(part, own) for part, own in parts]
        yield a, b, np.concatenate([r for r, _ in found] or [np.zeros(0, int)]), np.concatenate([v for _, v in found] or [np.zeros(0, np.uint64)])


def _pieces(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, space, up, down = _tables(len(data) + 1)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~space[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=total[1:])
    row = np.searchsorted(own[1:-1], starts, side="right")
    rows, values = [row], [(total[ends] - total[starts]) * down[starts] + np.uint64(7)]
    size = ends - starts
    for k in SIZES:
        long = size >= k
        s, e = starts[long], ends[long]
        rows += [row[long], row[long]]
        values += [(total[s + k] - total[s]) * down[s] + np.uint64(100 + k), (total[e] - total[e - k]) * down[e - k] + np.uint64(200 + k)]
    return np.concatenate(rows), np.concatenate(values)


class Table:
    """Looks pieces up in a fixed set; a bitmap passes most of the others by."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(values)
        self.sorted = values[self.order]
        self.sieve = np.zeros(1 << _BITS, dtype=bool)
        self.sieve[values >> np.uint64(64 - _BITS)] = True

    def present(self, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, number of the piece), sorted."""
        maybe = np.flatnonzero(self.sieve[values >> np.uint64(64 - _BITS)])
        rows, values = rows[maybe], values[maybe]
        if not len(self.sorted) or not len(values):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.sorted, values), len(self.sorted) - 1)
        hit = self.sorted[at] == values
        both = np.unique(rows[hit] * len(self.sorted) + self.order[at[hit]])
        return both // len(self.sorted), both % len(self.sorted)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; each text is the list of its pieces' numbers."""

    n = len(start)

    def sparse(x):
        return np.concatenate([*x, np.zeros(0, int)]).astype(int), np.repeat(np.arange(len(x)), [len(y) for y in x])

    (pi, pr), (ui, ur) = sparse(positive), sparse(unlabelled)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[:n], w[n] = start, -BIAS
    for t in range(1, STEPS + 1):
        zp, zu = (np.bincount(r, w[i], size) + w[n] for i, r, size in ((pi, pr, len(positive)), (ui, ur, len(unlabelled))))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # the loss of a positive is 1 - s, that of a negative is s
        negative = su.mean() - prior * sp.mean()
        slope_p, slope_u = prior * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        gp, gu = (-2 * slope_p, slope_u) if negative >= 0 else (slope_p, -slope_u)
        g = (np.bincount(pi, gp[pr], n + 1) + np.bincount(ui, gu[ur], n + 1)).astype(float)
        g[n] = gp.sum() + gu.sum()
        g[:n] += DECAY * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:n], float(w[n])


def _count(texts: DataFrame, table: Table | None) -> DataFrame:
    """(piece, n): in how many texts each piece is; with a table, by number."""
    import pyarrow as pa

    def run(batches):
        kept: list = []
        for batch in batches:
            for a, b, rows, values in pieces(batch.column(0)):
                if table is not None:
                    kept.append(np.unique(table.present(rows, values)[1].astype(np.int64), return_counts=True))
                else:
                    order = np.lexsort((values, rows))
                    r, v = rows[order], values[order]
                    new = np.ones(len(v), bool)
                    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
                    kept.append(np.unique(v[new].view(np.int64), return_counts=True))
        if kept:
            v, back = np.unique(np.concatenate([x[0] for x in kept]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x[1] for x in kept])).astype(np.int64)
            for k in range(0, len(v), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], ["piece", "n"])

    return texts.select("text").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", folds: int = 4, held: int = 2) -> tuple[np.ndarray, np.ndarray, float]:
    """Pieces, their weights and the bias."""
    import pyarrow as pa

    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_mod(key, folds) != held)).groupBy(key).agg(F.max(label).alias("y"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    nothing = np.zeros(0, np.uint64), np.zeros(0), -np.inf
    if not toxic or toxic == total:
        return nothing if not toxic else (*nothing[:2], np.inf)
    rows = docs.where(F.col(key).isNotNull() & (crc_mod(key, folds) != held)).select(F.col(key).alias("k"), text_hash(text).alias("h"), F.col(text).alias("text"))
    place = hashed("k", "h")
    confirmed = Settled(rows.select("k", "h").join(known.where("y = 1").select(F.col(key).alias("k")), "k").distinct(), "confirmed")
    # POSITIVES and UNLABELLED rows of ids and hashes are broadcast
    chosen = at_most(confirmed.df, place, POSITIVES, confirmed.df.count()), at_most(rows.select("k", "h"), place, UNLABELLED, rows.count())
    positive, unlabelled = (rows.join(F.broadcast(x), ["k", "h"]).dropDuplicates(["k", "h"]).select(F.lit(y).alias("y"), "text") for x, y in zip(chosen, (1, 0), strict=True))
    sample = Settled(positive.union(unlabelled), "sample")
    confirmed.drop()
    positive = sample.df.where("y = 1")
    n_p, n_u = positive.count(), sample.df.where("y = 0").count()
    if not n_p or not n_u:
        sample.drop()
        return nothing
    top = _count(positive, None).where(f"n >= {max(2, 0.004 * n_p)}").orderBy(F.desc("n"), "piece").limit(CANDIDATES).toPandas()
    values = top["piece"].to_numpy(np.int64).view(np.uint64)
    everywhere = np.zeros(len(values))
    for k, n in _count(sample.df.where("y = 0"), Table(values)).toPandas().itertuples(index=False):
        everywhere[k] = n
    p, u = (top["n"].to_numpy() + 0.1) / (n_p + 0.2), (everywhere + 0.1) / (n_u + 0.2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n_p * (p * np.log(p / u) + (1 - p) * np.log(np.maximum(1 - p, 1e-9) / np.maximum(1 - u, 1e-9)))
    pure = (gain >= GAIN) & (toxic / total * p >= PURITY * u)
    order = np.lexsort((values, -gain))
    order = order[pure[order]][:PIECES]
    chosen, start = values[order], np.minimum(np.log(p / u)[order], 3.0)
    table = Table(chosen)

    def run(batches):
        for batch in batches:
            for a, b, rows, found in pieces(batch.column(1)):
                r, k = table.present(rows, found)
                offsets = np.searchsorted(r, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(k.astype(np.int32)))], ["y", "k"])

    rows = sample.df.mapInArrow(run, "y int, k array<int>").toPandas()
    sample.drop()
    sides = [[np.asarray(x, dtype=int) for x in rows["k"][rows["y"] == y]] for y in (1, 0)]
    weights, bias = fit(*sides, toxic / total, start)
    return chosen, weights, bias


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """key, held_out, score (0 to 1) of every text."""
    import pyarrow as pa

    values, weights, bias = learn(docs, labels, label, text, key, folds, held)
    sent = docs.sparkSession.sparkContext.broadcast((values, weights, bias))  # PIECES weights

    def run(batches):
        values, weights, bias = sent.value
        table = Table(values)
        for batch in batches:
            for a, b, rows, found in pieces(batch.column(1)):
                r, k = table.present(rows, found)
                z = np.bincount(r, weights[k], b - a) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isfinite(bias) else np.full(b - a, float(bias > 0)))], [key, "score"])

    out = docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")
    return out.select(key, (crc_mod(key, folds) == held).alias("held_out"), "score")
