"""Benchmark decontamination by greedy string tiling.

Texts become words (runs of letters and digits, lower-cased, so punctuation and line breaks don't matter), known by
64-bit hashes. Seeds are runs of SEED words (all words of a shorter item). The seeds of a document are joined with the
sorted seeds of the benchmark; a bitmap passes most others by. The words of an item that lie in shared seeds bound what
tiles can cover, so items that can't reach COVERAGE go before any tiling, also where a seed is in very many items.
For each pair left, the longest match of unmarked words is marked again and again until none of SEED words is left: how
far each shared place reaches is found with running Karp-Rabin sums, window lengths falling by halves, and cut at what is
marked; where repeated words make more than PAIRS pairs of places, windows are compared as sets, in linear memory. So a passage that was cut and put back in another order is still covered by its tiles. An item leaks into a
document if its tiles cover at least COVERAGE of the item's words. An item of no words never leaks.

The benchmark goes to the executors in blocks of at most BLOCK_WORDS words, one pass over the documents for each
block, so what is broadcast is bounded and no item is left out; between the passes of ``drop_contaminated`` the rest is
written to the shared folder, so a task holds one block. Documents are handled row by row where they lie: nothing is
shuffled by key, and frequent passages make no hot task. A row's result depends on that row alone.

Each row of the benchmark is an item of its own, whatever its id: items may share an id or have none.

Nulls: a null text counts as empty and is never flagged; a null id is carried on. Ties between equally long
matches: the first place in the document, then in the item. Repeated rows give repeated results. An empty benchmark
flags nothing, and an empty table gives an empty result. Other columns pass through ``drop_contaminated`` unchanged,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideline.llm.frames import Settled, received, send
from tideline.llm.words import _tables, shingles

SEED = 5
COVERAGE = 0.6
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_BITS = 22
#: Pairs of places up to which they are listed; beyond it windows are compared as sets, with the same tiles.
PAIRS = 1 << 20


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of each range of ``counts[i]``, one after the other."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - first, counts)


class Block:
    """The words and the sorted seeds of some benchmark items."""

    def __init__(self, items: list[np.ndarray], seed: int = SEED):
        self.sizes = np.array([len(w) for w in items], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate([*items, np.zeros(0, np.uint64)]).astype(np.uint64)
        self.least = np.minimum(self.sizes, seed)
        self.tables = {}
        self.sieve = np.zeros(1 << _BITS, dtype=bool)
        for size in sorted(set(self.least.tolist()) - {0}):
            own = [i for i in range(len(items)) if self.least[i] == size]
            seeds = [shingles(items[i], size) for i in own]
            values = np.concatenate(seeds)
            item = np.repeat(np.array(own, dtype=np.int32), [len(x) for x in seeds])
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in seeds])
            order = np.argsort(values, kind="stable")
            keys, starts = np.unique(values[order], return_index=True)
            self.tables[size] = keys, np.append(starts, len(values)), item[order], place[order]
            self.sieve[keys >> np.uint64(64 - _BITS)] = True

    def found(self, words: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """(item, words covered, tiles, longest tile) for each item that leaks into the words."""
        for size, (keys, starts, item, place) in self.tables.items():
            own = shingles(words, size)
            at = np.flatnonzero(self.sieve[own >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            seed = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
            hit = keys[seed] == own[at]
            at, seed = at[hit], seed[hit]
            if not len(at):
                continue
            shared = np.unique(seed)
            count = starts[shared + 1] - starts[shared]
            rows = _spread(starts[shared], count)
            i, k, s = item[rows], place[rows], np.repeat(shared, count)
            order = np.lexsort((k, i))
            i, k, s = i[order], k[order], s[order]
            reach = np.full(len(i), size)
            reach[:-1] = np.where(i[1:] == i[:-1], np.minimum(size, k[1:] - k[:-1]), size)
            some, first = np.unique(i, return_index=True)
            covered = np.add.reduceat(reach, first)
            bounds = np.append(first, len(i))
            by_seed = np.argsort(seed, kind="stable")
            seed, at = seed[by_seed], at[by_seed]
            for n in np.flatnonzero(covered >= coverage * self.sizes[some]).tolist():
                one = int(some[n])
                mine, where = s[bounds[n] : bounds[n + 1]], k[bounds[n] : bounds[n + 1]]
                lo, hi = np.searchsorted(seed, mine, side="left"), np.searchsorted(seed, mine, side="right")
                item_words = self.words[self.offsets[one] : self.offsets[one + 1]]
                if (hi - lo).sum() <= PAIRS:
                    got = tile(words, item_words, at[_spread(lo, hi - lo)], np.repeat(where, hi - lo).astype(np.int64), size)
                else:  # places without their pairs, which repeated words make many of
                    _, once = np.unique(mine, return_index=True)
                    got = tile_windows(words, item_words, np.sort(at[_spread(lo[once], (hi - lo)[once])]), np.sort(where).astype(np.int64), size)
                if got and sum(got) >= coverage * self.sizes[one]:
                    yield one, sum(got), len(got), max(got)


def _sums(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _tables(len(words) + 1)[2][: len(words)], out=out[1:])
    return out


def reaches(a: np.ndarray, b: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How many words from a[at] on equal those from b[k] on: windows of falling lengths, compared by their running sums."""
    (one, two), down = (_sums(a), _sums(b)), _tables(max(len(a), len(b)) + 1)[3]
    most = np.minimum(len(a) - at, len(b) - k)
    out = np.zeros(len(at), dtype=np.int64)
    step = 1 << int(most.max(initial=1)).bit_length()
    while step := step // 2:
        go = np.flatnonzero(out + step <= most)
        x, y = at[go] + out[go], k[go] + out[go]
        same = (one[x + step] - one[x]) * down[x] == (two[y + step] - two[y]) * down[y]
        out[go[same]] += step
    return out


_CODES: dict[str, int] = {}


def codes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; the memory of seen words is emptied before it grows."""
    import xxhash

    if len(_CODES) > 500_000:
        _CODES.clear()
    get, put = _CODES.get, xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _CODES[w] = put(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def tile(words: np.ndarray, item: np.ndarray, at: np.ndarray, k: np.ndarray, least: int) -> list[int]:
    """Lengths of the tiles: longest common run of unmarked words first; (at, k) are all places where runs may start."""
    low = int(at.min())
    at = at - low
    order = np.lexsort((k, at))
    at, k = at[order], k[order]
    near = words[low : low + int(at.max()) + len(item)]
    full = reaches(near, item, at, k)
    next_a, next_b = np.full(len(near), len(near)), np.full(len(item), len(item))  # the first marked place from here on
    tiles: list[int] = []
    while True:
        length = np.minimum(full, np.minimum(next_a[at] - at, next_b[k] - k))
        best = int(length.argmax())  # the first of equal ones
        n = int(length[best])
        if n < least:
            return tiles
        for following, start in ((next_a, int(at[best])), (next_b, int(k[best]))):
            following[start : start + n] = np.arange(start, start + n)
            before = np.flatnonzero(following[:start] >= start)
            following[before] = start
        tiles.append(n)


def tile_windows(words: np.ndarray, item: np.ndarray, at: np.ndarray, k: np.ndarray, least: int) -> list[int]:
    """The same tiles in memory that is linear in both texts: the greatest length at which an unmarked window of either text is in
    the other is found by halving, as lengths only fall; ``at`` and ``k`` are the places where runs may start, in order."""
    low = int(at[0])
    near = words[low : int(at[-1]) + len(item)]
    at = at - low
    (one, two), down = (_sums(near), _sums(item)), _tables(max(len(near), len(item)) + 1)[3]
    ends = [np.full(len(near), len(near)), np.full(len(item), len(item))]  # the first marked place from here on
    tiles: list[int] = []

    def common(n: int) -> tuple[int, int] | None:
        """The first place in the words, then in the item, of an unmarked window of n words that both have."""
        x, y = at[ends[0][at] - at >= n], k[ends[1][k] - k >= n]
        if not len(x) or not len(y):
            return None
        a, b = (one[x + n] - one[x]) * down[x], (two[y + n] - two[y]) * down[y]
        hit = np.flatnonzero(np.isin(a, b))
        return None if not len(hit) else (int(x[hit[0]]), int(y[np.flatnonzero(b == a[hit[0]])[0]]))

    most = len(item)
    while True:
        n, high, found = least - 1, most, None
        while n < high:
            middle = (n + high + 1) // 2
            if (place := common(middle)) is not None:
                n, found = middle, place
            else:
                high = middle - 1
        if found is None:
            return tiles
        for following, start in zip(ends, found, strict=True):
            following[start : start + n] = np.arange(start, start + n)
            before = following[:start]
            before[before >= start] = start
        tiles.append(n)
        most = n


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list[np.ndarray], list]]:
    """Blocks of items as hashes of words, and the ids of their rows."""
    block: list = []
    ids: list = []
    size = 0
    for row in benchmark.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        w = codes(_WORD.findall(row[1].lower()))
        if block and size + len(w) > BLOCK_WORDS:
            yield block, ids
            block, ids, size = [], [], 0
        block.append(w)
        ids.append(row[0])
        size += len(w)
    if block:
        yield block, ids


def _matches(column, block: Block, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, words covered, tiles, longest tile) of the leaks in an Arrow column of texts."""
    for r, x in enumerate(column):
        text = x.as_py()
        if not text:
            continue
        for item, covered, tiles, longest in block.found(codes(_WORD.findall(text.lower())), coverage):
            yield r, item, covered, tiles, longest


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that leaks into it: covered words, share, tiles, longest tile."""
    import pyarrow as pa

    spark = docs.sparkSession
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {item_key} {benchmark.schema[item_key].dataType.simpleString()}, item_words long, covered_words long, coverage double, tiles long, longest_tile long"
    out = spark.createDataFrame([], schema)
    id_kind = to_arrow_type(benchmark.schema[item_key].dataType)
    for items, ids in _blocks(benchmark, item_key, item_text):
        sent = send(spark, (Block(items), ids))

        def run(batches, sent=sent):
            block, ids = received(sent)
            for batch in batches:
                rows = [(batch.column(0)[r].as_py(), ids[i], n, c, c / n, t, m) for r, i, c, t, m in _matches(batch.column(1), block, coverage) for n in [int(block.sizes[i])]]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [batch.column(0).type, id_kind, pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, item_key, "item_words", "covered_words", "coverage", "tiles", "longest_tile"])

        out = out.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, into which no benchmark item leaks."""
    import pyarrow as pa

    where, before = docs.columns.index(text), None
    for items, _ in _blocks(benchmark, item_key, item_text):
        if before is not None:
            docs = Settled(docs, "clean").df  # one block in a task at a time
        before = sent = send(docs.sparkSession, Block(items))

        def run(batches, sent=sent):
            block = received(sent)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for r, *_ in _matches(batch.column(where), block, coverage):
                    keep[r] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
