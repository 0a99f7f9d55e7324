"""Groups of spelling variants by merging the light subtrees of a trie of words (an errata trie).

Occurrences are maximal runs of letters (``LETTERS``), of which only A-Z are lower-cased. A run may lose one code point by a
rule of its id (``slipped``, the contract of the query: a stand-in for typing errors). Words are the distinct results of
at least ``least`` code points and ``often`` occurrences. Two words are near if one inserted, deleted or replaced code point
turns one into the other.

The trie of all words is a table of nodes, named by the hash of their prefix: each word gives its path, and grouped counts
give the words under each child. A node's heavy child leads to most words; every other edge, and the end of a word at a node
that has children, is light. A word passes at most log2(words) light edges. For a light edge from node p by character c
into the rest r of a word, where h leads to the heavy child, the light subtree is merged into its siblings:

- p + h + r, c replaced by the heavy character, coincides with a word of the heavy subtree;
- (p, r), c replaced by a joker, coincides among the light siblings, of which there are at most as many as letters;
- p + r, c skipped, coincides with any word under p;
- p + h + c + r, the heavy character put in, coincides with a word of the heavy subtree that has one character more.

Two near words part at one node, where at least one of them takes a light edge, so each pair coincides in one of these. Only
light subtrees are ever copied (small to large), so there are O(words * log words) copies, joined by their text. Prefix hashes
only choose the heavy character: were two prefixes to collide, more copies would be made and the pairs would be the same.
Paths of short prefixes are hot (all words pass the root): they are counted before and dealt over tasks by a salt.

A word's form is its near word of largest n (ties: smallest in code-point order) if that n is ``ratio`` times its own or more.
Roots follow forms to the end; n grows by ``ratio`` each step, so the longest way is known and doubling it ends in a few joins.

Cases: a null text has no words; a null id counts as empty text in the rule; rows that repeat an id count each; a word of any
length is kept, its path is made of hashes; an empty table gives an empty result. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.frames import Settled, Spread

LETTERS = "A-Za-zÀ-ÿ"
#: Distinct words a task gathers before it hands them on.
GATHERED = 1 << 17
_MASK, _STEP = (1 << 61) - 1, 0x1F3D5B79A7C9E
JOKER = "*"


def slipped(run: str, seed: int, modulus: int) -> str:
    """The run without one code point if ``modulus`` divides its crc32, continued from that of the id."""
    h = zlib.crc32(run.encode(), seed)
    if modulus and h % modulus == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, least: int, modulus: int, text: str, key: str) -> DataFrame:
    """(word, n) of runs with ``least`` code points or more, each task's own counts; not yet summed."""
    import pyarrow as pa

    def run(batches):
        found = re.compile(f"[{LETTERS}]{{{least},}}").finditer
        counts: dict[str, int] = {}

        def gathered():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                own: dict[str, int] = {}
                for m in found((value.as_py() or "").encode().lower().decode()):
                    own[m[0]] = own.get(m[0], 0) + 1
                seed = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for word, n in own.items():
                    word = slipped(word, seed, modulus)
                    if len(word) >= least:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > GATHERED:
                    yield from gathered()
        yield from gathered()

    return docs.select(F.col(key).cast("string"), text).mapInArrow(run, "word string, n long")


def paths(words: DataFrame) -> DataFrame:
    """(id, at, node, letter): for each word the hash of each of its prefixes and the next character, empty at the end."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                ids, at, nodes, letters = [], [], [], []
                for name, word in zip(*(c.slice(first, 2048).to_pylist() for c in batch.columns), strict=True):
                    h = 0
                    for k, c in enumerate(word):
                        nodes.append(h)
                        h = (h * _STEP + ord(c)) & _MASK
                    nodes.append(h)
                    ids += [name] * (len(word) + 1)
                    at += range(len(word) + 1)
                    letters += word
                    letters.append("")
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(nodes, pa.int64()), pa.array(letters, pa.string())], ["id", "at", "node", "letter"])

    return words.select(F.xxhash64("word"), "word").mapInArrow(run, "id long, at int, node long, letter string")


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, at, heavy): the light edges on each word's path, with their place and the heavy character of their node."""
    path = Settled(paths(words), "paths").df
    under = path.groupBy("node", "letter").agg(F.count("*").alias("words"))
    # the heavy child is one by a character; the end of a word counts as light
    nodes = under.groupBy("node").agg(F.max_by("letter", F.struct(F.col("letter") != "", "words", "letter")).alias("heavy"), F.sum("words").alias("all"), F.count("*").alias("children"))
    nodes = Settled(nodes.where("children > 1").select("node", "heavy", "all"), "nodes").df
    spread = Spread(nodes, ["node"], "all")
    light = spread.join(path, nodes.select("node", "heavy"), "id").where("letter <> heavy").select("id", "at", "heavy")
    return words.withColumn("id", F.xxhash64("word")).join(light.distinct(), "id").select("word", "n", "at", "heavy")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of all words (word, n) that one edit parts, each pair once and a < b."""
    light = Settled(light_edges(words), "light").df
    p, size = F.substr("word", F.lit(1), F.col("at")), F.char_length("word")
    rest, suffix = F.substr("word", F.col("at") + 2), F.substr("word", F.col("at") + 1)
    inside = F.col("at") < size
    copies = F.array(
        F.when(inside, F.concat(p, "heavy", rest)), F.when(inside, F.concat(p, rest)), F.concat(p, "heavy", suffix),
    )
    copied = light.select("word", "n", F.explode(copies).alias("copy")).where("copy IS NOT NULL")
    met = copied.join(words.select(F.col("word").alias("copy"), F.col("n").alias("m")), "copy").select("word", "n", F.col("copy").alias("other"), "m")
    # siblings of one node with the same rest: one for each light character at most
    joker = light.where(inside).groupBy(F.concat(p, F.lit(JOKER), rest).alias("key")).agg(F.collect_set(F.struct("word", "n")).alias("all")).where(F.size("all") > 1)
    among = joker.select(F.explode("all").alias("x"), "all").select("x.*", F.explode("all").alias("y")).select("word", "n", F.col("y.word").alias("other"), F.col("y.n").alias("m"))
    both = met.where("word <> other").unionByName(among.where("word < other"))
    first = F.col("word") < F.col("other")
    side = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return both.select(side("word", "other", "a"), side("n", "m", "n_a"), side("other", "word", "b"), side("m", "n", "n_b")).distinct()


def roots(forms: DataFrame, largest: int, often: int, ratio: int) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the way."""
    way = forms.select("word", F.col("form").alias("root"))
    longest = max(1, math.ceil(math.log(max(largest, often) / often, ratio)) + 1)
    done = 1
    while done < longest:
        # where many words have come to one root, its row is copied and they are dealt over tasks
        step = Settled(way, "roots").df
        far = Spread(step, ["root"]).join(step, step.select(F.col("word").alias("root"), F.col("root").alias("further")), "word", "left")
        way = far.select("word", F.coalesce("further", "root").alias("root"))
        done *= 2
    return way


def variants(docs: DataFrame, least: int = 6, often: int = 5, ratio: int = 5, modulus: int = 199, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; ``modulus`` 0 leaves all runs as they are."""
    words = word_counts(docs, least, modulus, text, key).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
    words = Settled(words, "words").df
    pairs = Settled(near_pairs(words), "near").df
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    known = words.join(best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.minus")).alias("m")), "word", "left")
    has = F.col("m") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("other")).alias("form"), F.when(has, F.col("m")).alias("form_n"))
    known = Settled(known, "known").df
    largest = words.agg(F.max("n")).first()[0] or 0
    found = roots(known.where("form IS NOT NULL"), largest, often, ratio)
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
