"""Language-model scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Tokens are words (A-Z lower-cased) and one end per text. The model predicts a class from the CONTEXT words before it:
each of the OWN most frequent words is a class of its own, the end is one, and all other words share RARE classes picked
by their first and last bytes. In the context, each of the INPUT most frequent words has a vector of its own, and the
others have one for each rare class. The predicted vector is the sum of a position's diagonal weights times the vectors
of the context's words; its products with the classes' output vectors, one matrix product for a block of tokens, go
through a softmax, so the probabilities of the classes sum to 1. Inside a rare class a word has the share
(c + 0.1) / (C + 0.1 * (V + 1)), with c its count, C and V the tokens and distinct words of the class, and one part for
all unseen words; so the tokens' probabilities sum to 1, too.

What is gathered grows with the corpus: counts of all words of all training texts (map-side sums of word hashes, then
one grouped sum). At most FREQUENT of the most frequent words, cut at a count that a histogram of counts gives, are sent
to the executors; the counts of the others meet the texts in a join on (word), after words were summed up within each
text. The neural model is trained by local SGD on every partition of the training texts, on all positions of all texts,
the ends included: texts lie one after the other with CONTEXT starts between them, so a block's predicted vectors are
weighted sums of shifted slices. The parameters of all partitions are averaged by a grouped mean weighted by windows,
ROUNDS times.

Nulls: a null text counts as empty (one token, the end); a null id counts as the text '' for the fold. Repeated rows are
scored each. An empty table gives an empty result. Without training texts all words are unseen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import Settled, crc_mod, received, send
from tideline.llm.words import PIECE, mixed, row_words

FREQUENT, INPUT = 1 << 16, 1023
OWN, RARE, CONTEXT, WIDTH = 255, 128, 5, 24
START = INPUT + 1 + RARE
NOISE, ROUNDS, BATCH = 48, 1, 256
RATE, HALF, PAST = 1.5, 5e4, 0.1
SLOTS = 20
LOG10 = float(np.log(10.0))


class Vocabulary:
    """Frequent words by hash, most frequent first: the first OWN are classes; class OWN is the end; then RARE classes.

    As inputs: the first INPUT words, INPUT is the end (never seen in a context), then RARE classes, START at last."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, tokens: int, words: int, ends: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.rank = hashes[order], counts[order], order
        self.class_tokens, self.class_words = class_tokens, class_words
        self.tokens, self.words, self.ends = tokens, words, ends
        self.unigram = np.ones(OWN + 1 + RARE)
        self.unigram[: min(OWN, len(counts))] += counts[:OWN]
        self.unigram[OWN] += ends
        self.unigram[OWN + 1 :] += class_tokens
        self.rare_total = class_tokens + 0.1 * (class_words + 1)
        # two words at most start from each of 2^SLOTS high bits; what else there is comes by a search
        slot = (self.hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.slots = np.full((2, 1 << SLOTS), len(self.hashes), dtype=np.int32)
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        for k in (0, 1):
            self.slots[k, slot[nth == k]] = np.flatnonzero(nth == k)
        self.crowded = bool((nth > 1).any())
        self.keys = np.append(self.hashes, np.uint64(0))  # the last place stands for words that aren't frequent
        rank = np.append(self.rank, FREQUENT)
        self.known = np.append(self.counts, -1.0), np.where(rank < OWN, rank, -1), np.where(rank < INPUT, rank, -1)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, input, count) of words by hash; count -1: not frequent."""
        rare, none = rare_class(h), len(self.hashes)
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        at = self.slots[0].take(slot)
        wrong = np.flatnonzero((self.keys.take(at) != h) & (at < none))
        if len(wrong):
            other = self.slots[1].take(slot[wrong])
            if self.crowded:
                other = np.minimum(np.searchsorted(self.hashes, h[wrong]), none - 1)
            at[wrong] = np.where(self.keys.take(other) == h[wrong], other, none)
        count, kind, given = (x.take(at) for x in self.known)
        return np.where(kind < 0, OWN + 1 + rare, kind), np.where(given < 0, INPUT + 1 + rare, given), count


def rare_class(h: np.ndarray) -> np.ndarray:
    """Rare class of a tagged word hash: its low bits (see tagged)."""
    return (h & np.uint64(RARE - 1)).astype(np.int64)


def tagged(hashes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Word hashes with the low bits replaced by the class of the word's first and last bytes."""
    return (hashes & ~np.uint64(RARE - 1)) | (mixed(tags) & np.uint64(RARE - 1))


def text_words(column):
    """(first row, last row + 1, tagged word hashes, offsets) of an Arrow column."""
    yield from row_words(column, PIECE, tags=tagged)


class Model:
    """Vectors of inputs, output vectors of classes, weights of positions, and biases of classes."""

    def __init__(self, parameters: np.ndarray | None = None, vocabulary: Vocabulary | None = None):
        n, d = OWN + 1 + RARE, WIDTH
        self.shapes = [(START + 1, d), (n, d), (CONTEXT, d), (n,)]
        if parameters is None:
            rng = np.random.default_rng(20240229)
            u = vocabulary.unigram / vocabulary.unigram.sum()
            parts = [rng.normal(0, 0.3, (START + 1, d)), rng.normal(0, 0.1, (n, d)), np.full((CONTEXT, d), 1.0 / CONTEXT**0.5), np.log(u)]
            parameters = np.concatenate([p.ravel() for p in parts])
        self.parameters = parameters.astype(np.float32)
        self.past: list = []  # sums of squares of the gradients
        self.seen = 0  # places trained on
        at, self.parts = 0, []
        for s in self.shapes:
            k = int(np.prod(s))
            self.parts.append(self.parameters[at : at + k].reshape(s))
            at += k

    def predicted(self, around: np.ndarray) -> np.ndarray:
        """Predicted vectors of all but the first CONTEXT of consecutive inputs' vectors."""
        n, weights = len(around) - CONTEXT, self.parts[2]
        q = around[CONTEXT - 1 : CONTEXT - 1 + n] * weights[0]
        for k in range(1, CONTEXT):
            q += around[CONTEXT - 1 - k : CONTEXT - 1 - k + n] * weights[k]
        return q

    def log_probabilities(self, given: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the classes at all places with a class (kind >= 0), normalised over all classes."""
        vectors, output, _, bias = self.parts
        places = np.flatnonzero(kind >= 0)
        out = np.empty(len(places))
        targets = np.ascontiguousarray(np.concatenate([output, bias[:, None]], axis=1).T)
        longest = float(np.sqrt((targets.astype(np.float64) ** 2).sum(axis=0).max()))
        for a in range(0, len(places), 512):
            at = places[a : a + 512]
            lo, hi = at[0] - CONTEXT, at[-1] + 1
            q = np.empty((len(at), WIDTH + 1), np.float32)
            q[:, :-1] = self.predicted(vectors.take(given[lo:hi], axis=0)).take(at - lo - CONTEXT, axis=0)
            q[:, -1] = 1
            s = q @ targets
            if longest * float(np.sqrt(np.einsum("nd,nd->n", q, q).max())) > 80:  # else exp needs no shift
                np.clip(s, -80, 80, out=s)
            own = s[np.arange(len(s)), kind[at]].astype(np.float64)
            out[a : a + 512] = own - np.log(np.exp(s, out=s).sum(axis=1))
        return out

    def train(self, given: np.ndarray, kind: np.ndarray, unigram: np.ndarray, seed: int) -> None:
        """Noise-contrastive estimation: the true class against NOISE classes from the unigram, by AdaGrad, in blocks of
        consecutive places that are taken in a random order; the rate falls with the places seen."""
        rng = np.random.default_rng(seed)
        noise = unigram / unigram.sum()
        # NOISE classes are drawn per block, and weigh as NOISE / 4 of them a place
        log_noise = np.log(NOISE / 4 * noise).astype(np.float32)
        vectors, output, weights, bias = self.parts
        past = self.past = self.past or [np.full(p.shape, PAST, np.float32) for p in self.parts]
        cumulative = np.cumsum(noise)

        def step(part: int, rows: np.ndarray, grad: np.ndarray, n: int) -> None:
            order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
            rows = rows.take(order)
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            rows = rows.take(first)
            g = np.add.reduceat(grad.take(order, axis=0), first, axis=0) * np.float32(1 / n)
            now = past[part].take(rows, axis=0) + g * g * np.float32(n)
            past[part][rows] = now
            self.parts[part][rows] -= np.float32(rate * min(1.0, n / 64)) * g / np.sqrt(now)

        starts = np.arange(CONTEXT, len(kind), BATCH)
        for a in rng.permutation(starts).tolist():
            b = min(len(kind), a + BATCH)
            t = kind[a:b]
            seen = t >= 0
            n = int(seen.sum())
            if not n:
                continue
            rate = RATE / (1 + self.seen / HALF) ** 0.5
            self.seen += n
            c = given[a - CONTEXT : b - 1]
            around = vectors.take(given[a - CONTEXT : b], axis=0)
            q = self.predicted(around)
            if n < len(t):
                q *= seen[:, None]
                t = np.where(seen, t, 0)
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(noise) - 1)
            own, other = output.take(t, axis=0), output.take(drawn, axis=0)
            good = -1 / (1 + np.exp(np.einsum("nd,nd->n", q, own) + (bias - log_noise).take(t)))
            bad = q @ other.T
            bad += bias[drawn] - log_noise[drawn]
            np.negative(bad, out=bad)
            np.exp(bad, out=bad)
            bad += 1
            np.divide(np.float32(0.25), bad, out=bad)
            if n < len(t):
                good *= seen
                bad *= seen[:, None]
            g_q = bad @ other
            g_q += good[:, None] * own
            rows = np.concatenate([t, drawn])
            step(1, rows, np.concatenate([good[:, None] * q, bad.T @ q]), n)
            step(3, rows, np.concatenate([good, bad.sum(0)]), n)
            g_w = np.empty_like(weights)
            g_c = np.zeros((len(c), WIDTH), np.float32)
            m = len(t)
            for k in range(CONTEXT):
                lo = CONTEXT - 1 - k
                g_w[k] = np.einsum("nd,nd->d", g_q, around[lo : lo + m])
                g_c[lo : lo + m] += g_q * weights[k]
            step(0, c, g_c, n)
            step(2, np.arange(CONTEXT), g_w, n)


def laid_out(kind: np.ndarray, given: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and classes (-1: none) of texts one after the other, each after CONTEXT starts and before its end; and the
    offsets of the texts' tokens, ends included."""
    n = len(offsets) - 1
    shift = np.arange(n) * (CONTEXT + 1) + CONTEXT
    size = int(offsets[-1] - offsets[0]) + n * (CONTEXT + 1)
    inputs, classes = np.full(size, START, dtype=np.int64), np.full(size, -1, dtype=np.int64)
    at = np.arange(len(kind)) + np.repeat(shift, np.diff(offsets))
    inputs[at], classes[at] = given, kind
    ends = offsets[1:] - offsets[0] + shift
    inputs[ends], classes[ends] = INPUT, OWN
    return inputs, classes, offsets - offsets[0] + np.arange(n + 1)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): the words of all texts by tagged hash, summed up before they are shuffled."""
    import pyarrow as pa

    def run(batches):
        kept: list = []
        size = 0

        def flush():
            h, n = np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept])
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, n = h[first], np.add.reduceat(n, first)
            for a in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], ["word", "n"])

        for batch in batches:
            for _, _, hashes, _ in text_words(batch.column(0)):
                if len(hashes):
                    kept.append(np.unique(hashes, return_counts=True))
                    size += len(kept[-1][0])
                if size > 3_000_000:
                    yield from flush()
                    kept, size = [], 0
        if kept:
            yield from flush()

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """Totals, and at most FREQUENT of the most frequent words: those above a count at which the histogram of counts (by
    64ths of a power of two, so of some 4,000 rows) holds as many."""
    bins = F.floor(F.log2("n") * 64).cast("int")
    histogram = counts.groupBy(bins.alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    cut, sum_of_words = None, 0
    for bin_, _, words in sorted(histogram, reverse=True):
        sum_of_words += words
        if sum_of_words > FREQUENT:
            break
        cut = bin_
    if cut is None:
        hashes, n = np.zeros(0, np.uint64), np.zeros(0)
    else:
        top = counts.where(bins >= cut).toPandas().sort_values(["n", "word"], ascending=[False, True])
        hashes, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64)
    own = [int(x) for x in hashes[:OWN].view(np.int64)]
    kind = F.col("word").bitwiseAND(F.lit(RARE - 1))
    rare = counts.where(~F.col("word").isin(own)) if own else counts
    tokens, words = np.zeros(RARE), np.zeros(RARE)
    for k, c, v in rare.groupBy(kind.alias("k")).agg(F.sum("n"), F.count("*")).collect():  # RARE rows
        tokens[k], words[k] = c, v
    return Vocabulary(hashes, n, tokens, words, sum(x["n"] for x in histogram), sum(x["words"] for x in histogram), ends)


def train(docs: DataFrame, text: str, known: Vocabulary) -> Model:
    """Local SGD on every partition, then the mean of the parameters, ROUNDS times."""
    import pyarrow as pa

    spark = docs.sparkSession
    model = Model(vocabulary=known)
    sent_known = send(spark, known)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model.parameters)

        def run(batches, sent=sent, turn=turn):
            own, known = Model(sent.value.copy()), received(sent_known)
            waiting = 0
            parts: list = []

            def learn():
                nonlocal waiting
                own.train(*(np.concatenate(x) for x in zip(*parts, strict=True)), known.unigram, turn)
                parts.clear()
                waiting = 0

            for batch in batches:
                for _, _, hashes, offsets in text_words(batch.column(0)):
                    kind, given, _ = known.look_up(hashes)
                    parts.append(laid_out(kind, given, offsets)[:2])
                    waiting += len(parts[-1][1])
                    if waiting > 100_000:
                        learn()
            if waiting:
                learn()
            if own.seen:
                n = len(own.parameters)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(own.parameters.astype(np.float64) * own.seen), pa.array(np.full(n, float(own.seen)))], ["k", "p", "w"])

        # one row per parameter: its number does not grow with the input
        mean = docs.select(text).mapInArrow(run, "k int, p double, w double").groupBy("k").agg((F.sum("p") / F.sum("w")).alias("p")).toPandas()
        if len(mean):
            model = Model(mean.sort_values("k")["p"].to_numpy())
    return model


def fit(docs: DataFrame, text: str = "text") -> tuple[Settled, Vocabulary, Model]:
    """Counts of all words, vocabulary and model of the texts."""
    counts = Settled(word_counts(docs, text), "counts")
    known = vocabulary(counts.df, docs.count())
    return counts, known, train(docs, text, known)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 10) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of all texts; learned from fold <> 0."""
    import pyarrow as pa

    spark = docs.sparkSession
    counts, known, model = fit(docs.where(crc_mod(key, folds) != 0), text)
    ends = known.ends
    # the end of each text is a token of the training texts, too: one more distinct token if there is any text
    total, distinct = known.tokens + ends, known.words + (ends > 0)
    base_end = float(np.log10(ends + 0.1))
    sent = send(spark, (known, model.parameters))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        known, parameters = received(sent)
        own = Model(parameters)
        log_rare = np.log10(known.rare_total)
        for batch in batches:
            for a, b, hashes, offsets in text_words(batch.column(1)):
                n = b - a
                classes, given, count = known.look_up(hashes)
                inputs, kinds, tokens = laid_out(classes, given, offsets)
                row = np.repeat(np.arange(n), np.diff(offsets))
                p = np.add.reduceat(own.log_probabilities(inputs, kinds), tokens[:-1]) / LOG10
                add = lambda x: np.bincount(row, x, n)
                rare = classes > OWN
                in_class = np.zeros(len(hashes))
                in_class[rare] = log_rare[classes[rare] - OWN - 1]
                frequent = count >= 0
                log_count = np.where(frequent, np.log10(np.maximum(count, 0) + 0.1), 0.0)
                base = add(log_count) + base_end
                model_score = p + add(np.where(rare, log_count, 0.0)) - add(in_class)
                # words without a frequent count: their counts come by the join
                r, h = row[~frequent], hashes[~frequent]
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, int)
                times = np.diff(np.concatenate([first, [len(r)]]))
                r, h = r[first], h[first].view(np.int64)
                bounds = np.searchsorted(r, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n), pa.array(np.diff(tokens).astype(np.int64)), pa.array(add(frequent).astype(np.int64) + int(ends > 0)),
                        pa.array(base), pa.array(model_score), pa.ListArray.from_arrays(pa.array(bounds), pa.array(h)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
                    ],
                    ["id", "n_tokens", "n_known", "base", "score", "words", "times"],
                )

    rows = docs.select(key, text).mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base double, score double, words array<long>, times array<int>")
    # a row's number is unique in the written table, and stays the same in every later read of it
    rows = Settled(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    pairs = rows.df.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    seen = counts.df.withColumnRenamed("n", "c")
    joined = pairs.join(seen, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("hits"))
    out = rows.df.select("row", "id", "n_tokens", "n_known", "base", "score").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        F.col("id").alias(key), (crc_mod("id", folds) == 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("hits", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + logs - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
