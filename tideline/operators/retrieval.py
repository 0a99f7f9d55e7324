"""Ranking a corpus for many queries: BM25, dense products, reciprocal-rank fusion, deterministic top-k."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.text import tokens

K1, B, RRF_K, TOP = 1.5, 0.75, 60, 20
#: Documents that a task looks at side by side, and products that it makes of them at once (fixed values).
SLICE, PRODUCTS = 1024, 1_000_000
#: Vectors that a task multiplies with a block of queries at once.
VECTORS = 512


def top_k(scores: DataFrame, run: list[str], item: str, k: int = TOP, score: str = "score") -> DataFrame:
    """Ranks 1 to k in each run by falling score, then item."""
    w = W.partitionBy(*run).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, query: str, text: str, most: int, words: int):
    """(ids, {term: [(query number, times)]}) of at most ``most`` queries, and about ``words`` terms, with tokens."""
    ids, terms, size = [], {}, 0
    for name, found in queries.select(query, tokens(text)).toLocalIterator():
        if not found:
            continue
        for t in found:
            own = terms.setdefault(t, {})
            size += len(ids) not in own
            own[len(ids)] = own.get(len(ids), 0) + 1
        ids.append(name)
        if len(ids) == most or size >= words:
            yield ids, terms
            ids, terms, size = [], {}, 0
    if ids:
        yield ids, terms


def _slices(batches):
    """Record batches of at most SLICE rows: arrays over a batch's words don't grow with the rows of a partition."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def _best(q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by falling score (NaN first, as Spark has it), then id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -s, ~np.isnan(s), q))
    q, s, ids = q[order], s[order], ids[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], s[keep], ids[keep]


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str = "text", k: int = TOP, block: int = 2048, words: int = 200_000) -> DataFrame:
    """(query, doc, score, rank). Blocks of queries, of a bounded number of terms, are sent to the documents: one pass counts
    the documents of each term, one scores them, and each task keeps its k best per query before anything is shuffled.
    Documents without any term fill up to k with score 0, least ids first; a query without tokens gets nothing. Query ids are
    unique; documents with a null id are left out, those with a null text count as empty."""
    hits, asked = _bm25(docs, queries, doc, query, text, k, block, words)
    best = top_k(hits, [query], doc, k)
    # where fewer than k are found, those are all there are; at most 2k least ids can be needed
    short = asked.join(best.groupBy(query).agg(F.count("*").alias("have")), query, "left").where(F.coalesce("have", F.lit(0)) < k).select(query)
    fill = docs.select(doc).where(F.col(doc).isNotNull()).orderBy(doc).limit(2 * k)
    padded = short.join(F.broadcast(fill), F.lit(True)).join(best.select(query, doc), [query, doc], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.drop("rank").unionByName(padded), [query], doc, k)


def bm25_scores(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str = "text", block: int = 2048, words: int = 200_000) -> DataFrame:
    """(query, doc, score) of every query with tokens and every document, those without any of its terms too: the table
    of a full ranking, made where the documents lie. Its size is the number of queries times that of documents."""
    return _bm25(docs, queries, doc, query, text, None, block, words)[0]


def _bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int | None, block: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Scores (each task's k best of a query, or all), and the queries with tokens."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    bags = docs.where(F.col(doc).isNotNull()).select(doc, tokens(F.coalesce(text, F.lit(""))).alias("t"))
    kinds = {query: queries.schema[query].dataType, doc: docs.schema[doc].dataType}
    schema = f"{query} {kinds[query].simpleString()}, {doc} {kinds[doc].simpleString()}, score double"
    query_type = to_arrow_type(kinds[query])
    hits = spark.createDataFrame([], schema)
    asked = spark.createDataFrame([], f"{query} {kinds[query].simpleString()}")
    for ids, terms in _query_blocks(queries, query, text, block, words):
        sent_terms = spark.sparkContext.broadcast(list(terms))

        def count(batches, sent=sent_terms):
            wanted = pa.array(sent.value, pa.string())
            seen, n, length = np.zeros(len(wanted), np.int64), 0, 0
            for batch in _slices(batches):
                column = batch.column(1)
                at = pc.index_in(column.flatten(), value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
                found = np.unique(row[at >= 0] * len(wanted) + at[at >= 0])
                seen += np.bincount(found % len(wanted), minlength=len(wanted))
                n, length = n + len(column), length + len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(wanted))), pa.array(np.concatenate([[length, n], seen]).astype(np.int64))], ["term", "n"])

        # a row per term of the block
        counted = dict(map(tuple, bags.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
        n, mean = counted.get(-1, 0), counted.get(-2, 0) / max(1, counted.get(-1, 0))
        df = np.array([counted.get(i, 0) for i in range(len(terms))], dtype=float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        starts = np.cumsum([0, *map(len, terms.values())])
        who = np.array([q for own in terms.values() for q in own], dtype=np.int64)
        times = np.array([c for own in terms.values() for c in own.values()], dtype=float)
        sent = spark.sparkContext.broadcast((list(terms), ids, idf, starts, who, times, mean))

        def run(batches, sent=sent):
            wanted, ids, idf, starts, who, times, mean = sent.value
            wanted = pa.array(wanted, pa.string())
            kept = None

            def table(q, s, found, kind):
                return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], query_type), pa.array(found.tolist(), kind), pa.array(s, pa.float64())], [query, doc, "score"])

            for batch in _slices(batches):
                names = batch.column(0).to_numpy(zero_copy_only=False)
                lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                at = pc.index_in(batch.column(1).flatten(), value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(names)), lengths)[at >= 0]
                pair, tf = np.unique(row * len(wanted) + at[at >= 0], return_counts=True)
                row, term = pair // len(wanted), pair % len(wanted)
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean))
                fan = np.diff(starts)[term]
                # parts of at most some PRODUCTS products, at document ends
                work = np.concatenate([[0], np.cumsum(np.bincount(row, fan, len(names)))])
                a = 0
                while a < len(names):
                    b = max(a + 1, min(int(np.searchsorted(work, work[a] + PRODUCTS, side="right")) - 1, a + PRODUCTS // len(ids)))
                    lo, hi = np.searchsorted(row, [a, b])
                    f = fan[lo:hi]
                    post = np.repeat(starts[term[lo:hi]] - np.concatenate([[0], np.cumsum(f)[:-1]]), f) + np.arange(f.sum())
                    place = np.repeat(row[lo:hi] - a, f) * len(ids) + who[post]
                    score = np.bincount(place, np.repeat(weight[lo:hi], f) * times[post], (b - a) * len(ids))
                    hit = np.flatnonzero(score) if k is not None else np.arange(len(score))
                    part = (hit % len(ids), np.round(score[hit], 9), names[a:b][hit // len(ids)])
                    if k is None:
                        yield table(*part, batch.column(0).type)
                        a = b
                        continue
                    kept = _best(*(part if kept is None else (np.concatenate(x) for x in zip(kept, part, strict=True))), k)
                    a = b
            if kept is not None and len(kept[0]):
                yield table(*kept, batch.column(0).type)

        hits = hits.unionByName(bags.mapInArrow(run, schema))
        asked = asked.unionByName(spark.createDataFrame([(i,) for i in ids], asked.schema))
    return hits, asked


def dense(vectors: DataFrame, queries: DataFrame, item: str, query: str, vector: str = "embedding", k: int = TOP, block: int = 2048) -> DataFrame:
    """(query, item, score, rank) by dot product: blocks of queries are sent to the vectors, one matrix product per batch,
    and each task keeps its k best per query before anything is shuffled."""
    import pyarrow as pa

    spark = vectors.sparkSession
    schema = f"{query} {queries.schema[query].dataType.simpleString()}, {item} {vectors.schema[item].dataType.simpleString()}, score double"
    out = spark.createDataFrame([], schema)

    def blocks():
        ids, rows = [], []
        for a, v in queries.select(query, vector).toLocalIterator():
            ids.append(a)
            rows.append(v)
            if len(ids) == block:
                yield ids, np.array(rows, dtype=np.float64)
                ids, rows = [], []
        if ids:
            yield ids, np.array(rows, dtype=np.float64)

    for ids, matrix in blocks():
        sent = spark.sparkContext.broadcast((np.array(ids), matrix))

        def run(batches, sent=sent):
            ids, matrix = sent.value
            kept = None
            for batch in batches:
                for a in range(0, batch.num_rows, VECTORS):
                    part = batch.slice(a, VECTORS)
                    m = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    names, kind = part.column(0).to_numpy(zero_copy_only=False), part.column(0).type
                    s = np.round(matrix @ m.T, 9)
                    # what is less than a slice's k-th can't be among the k best; its equals can
                    least = np.partition(s, -k, axis=1)[:, -k, None] if part.num_rows > k else np.full((len(ids), 1), -np.inf)
                    q, v = np.nonzero(~(s < least))
                    found = (q, s[q, v], names[v])
                    kept = _best(*(found if kept is None else (np.concatenate(x) for x in zip(kept, found, strict=True))), k)
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[2], kind), pa.array(kept[1])], [query, item, "score"])

        out = out.unionByName(vectors.select(item, vector).mapInArrow(run, schema))
    return top_k(out, [query], item, k)


def rrf(rankings: DataFrame, run: list[str], item: str, k: int = TOP) -> DataFrame:
    """Fuses several rankings of a run: sum of 1 / (RRF_K + rank)."""
    fused = rankings.groupBy(*run, item).agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))), 12).alias("score"))
    return top_k(fused, run, item, k)


#: Words that don't count for the similarity of short texts (fixed values).
STOP_WORDS = "a about after alone an and are as at be before by can do does each even for from if in is it its may more must needs not of on only or rather same should so some than that the then this to when with".split()


def similar_pairs(items: DataFrame, key: str, text: str, least: float = 0.28) -> DataFrame:
    """(left_id, right_id, jaccard) of texts with similar sets of words [a-z]+ without stop words, lower id first. Pairs come
    from an equi-join on the words of each set's prefix: two sets that are similar enough share a word among the rarest
    of each, so frequent words make no pairs."""
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))), F.array(*[F.lit(w) for w in STOP_WORDS]))
    sets = items.select(key, words.alias("_w")).where(F.size("_w") > 0)
    terms = sets.select(key, F.explode("_w").alias("_t"))
    rare = terms.join(terms.groupBy("_t").agg(F.count("*").alias("_n")), "_t")
    ranked = rare.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_o"))  # one text's words
    size = F.size("_o")
    prefix = size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1
    seeds = ranked.select(key, F.explode(F.slice("_o", F.lit(1), prefix)).alias("_s")).select(key, "_s._t")
    near = seeds.join(seeds.select(F.col(key).alias("right_id"), "_t"), "_t").where(F.col(key) < F.col("right_id")).select(F.col(key).alias("left_id"), "right_id").distinct()
    a, b = sets.select(F.col(key).alias("left_id"), F.col("_w").alias("_a")), sets.select(F.col(key).alias("right_id"), F.col("_w").alias("_b"))
    both = near.join(a, "left_id").join(b, "right_id")
    return both.select("left_id", "right_id", (F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))).alias("jaccard")).where(F.col("jaccard") >= least)


def reranked(ranking: DataFrame, scores: DataFrame, run: list[str], item: str, k: int = TOP) -> DataFrame:
    """The same top k in the order of another score; items without one come last."""
    pool = ranking.where(F.col("rank") <= k).select(*run, item).join(scores.select(*run, item, "score"), [*run, item], "left")
    return top_k(pool, run, item, k)


#: Retrievers by name; each ranks (docs, queries, doc, query).
RETRIEVERS = {"bm25": bm25, "dense": dense}
