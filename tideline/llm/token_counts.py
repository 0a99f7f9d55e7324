"""Token counts that follow edits: a segment tree of pre-tokens per document.

A text is split into pre-tokens by the tokenizer's pattern; each has its length and its number of byte-pair tokens. The
tree's leaves are runs of about RUN pre-tokens, its inner nodes hold the sums of characters, pre-tokens and tokens below.
An edit (start, end, replacement; in characters of the text as the edits before have left it) finds its leaf by the sums,
re-encodes the text from the pre-token whose match can see the edit (a match looks at most two characters beyond its end)
up to the first old boundary after the edit at which a new pre-token ends, too; from there on the split can't differ, as a
match depends on what follows only. The touched leaves are replaced and the sums on their paths added up again.

``build_trees`` gives each document its tree as a binary column (run sizes, lengths, counts, sums), which can be written
and kept; ``apply_edits`` takes texts with kept trees and edits and gives the new texts, trees and counts: of a text it
encodes only what an edit touches. ``count_tokens`` does one after the other.

The tokenizer's file is read by the driver and sent to the executors (some 50,000 ranks). Nulls: a null text counts as
empty; null edits are none; null ids are carried on. Edits are cut to the text's length. Repeated rows are counted each,
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RUN, SIGHT, REMEMBERED = 64, 2, 300_000
#: Rows whose trees are made at a time.
AT_ONCE = 256


class Counter:
    """Splits texts, and counts the tokens of pre-tokens; counts of seen pre-tokens are remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.split = regex.compile(PATTERN).findall
        self.finditer = regex.compile(PATTERN).finditer
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known, one = self.known, self.encoding.encode_ordinary
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in parts:
            n = known.get(p)
            if n is None:
                n = len(one(p))
                if len(p) < 64:
                    known[p] = n
            out.append(n)
        return out


class Tree:
    """Sums over runs of pre-tokens: ``levels[0]`` has a row (characters, pre-tokens, tokens) per run, each level above half."""

    def __init__(self, lengths: list[int], counts: list[int], runs: list | None = None):
        if runs is not None:
            self.runs = runs
            return
        self.runs = [(lengths[k : k + RUN], counts[k : k + RUN]) for k in range(0, len(lengths), RUN)] or [([], [])]
        self.build(np.array([[sum(a), len(a), sum(b)] for a, b in self.runs], dtype=np.int64), 0)

    def packed(self) -> bytes:
        """Numbers of runs and pre-tokens and the widths of their values; run sizes, lengths, counts; the sums of all levels."""
        lengths, counts = (np.array([x for r in self.runs for x in r[k]], dtype=np.int64) for k in (0, 1))
        kinds = [np.min_scalar_type(int(x.max(initial=0))) for x in (lengths, counts)]
        head = np.array([len(self.runs), len(lengths), *(k.itemsize for k in kinds)], dtype="<i8")
        parts = [head, np.array([len(r[0]) for r in self.runs], dtype="<i4"), lengths.astype(kinds[0]), counts.astype(kinds[1]), *self.levels]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        n, m, a, b = np.frombuffer(data, "<i8", 4).tolist()
        sizes = np.frombuffer(data, "<i4", n, 32)
        at = 32 + 4 * n
        lengths, counts = np.frombuffer(data, f"<u{a}", m, at), np.frombuffer(data, f"<u{b}", m, at + a * m)
        at += (a + b) * m
        ends = np.cumsum(sizes).tolist()
        # runs are views until an edit touches them
        tree = cls([], [], [(lengths[e - s : e], counts[e - s : e]) for s, e in zip(sizes.tolist(), ends, strict=True)])
        tree.levels = []
        while not tree.levels or len(tree.levels[-1]) > 1:
            rows = n if not tree.levels else (len(tree.levels[-1]) + 1) // 2
            tree.levels.append(np.frombuffer(data, "<i8", 3 * rows, at).reshape(rows, 3).copy())
            at += 24 * rows
        return tree

    def build(self, leaves: np.ndarray, first: int) -> None:
        """All sums anew from run ``first`` on, those before it are kept where they cover the same runs."""
        old = getattr(self, "levels", [])
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            d, keep = len(self.levels), 0
            up = np.zeros(((len(below) + 1) // 2, 3), dtype=np.int64)
            if d < len(old):
                keep = min(first >> d, len(old[d]), len(up))
                up[:keep] = old[d][:keep]
            rest = below[2 * keep :]
            up[keep : keep + len(rest) // 2] = rest[: len(rest) // 2 * 2].reshape(-1, 2, 3).sum(1)
            if len(rest) % 2:
                up[-1] = rest[-1]
            self.levels.append(up)

    def change(self, run: int) -> None:
        """Adds up the path above one changed run."""
        a, b = self.runs[run]
        self.levels[0][run] = (sum(a), len(a), sum(b))
        for d in range(1, len(self.levels)):
            run //= 2
            self.levels[d][run] = self.levels[d - 1][2 * run : 2 * run + 2].sum(0)

    @property
    def total(self) -> np.ndarray:
        return self.levels[-1][0]

    def find(self, place: int) -> tuple[int, int]:
        """(run, its first character) of the run that holds the character, or the last."""
        k, at = 0, 0
        for d in range(len(self.levels) - 2, -1, -1):
            k *= 2
            left = int(self.levels[d][k][0])
            if place >= at + left and k + 1 < len(self.levels[d]):
                at += left
                k += 1
        return k, at

    def replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Runs first to last become runs of the given pre-tokens."""
        if first == last and 0 < len(lengths) <= 2 * RUN:
            self.runs[first] = (lengths, counts)
            self.change(first)
            return
        new = [(lengths[k : k + RUN], counts[k : k + RUN]) for k in range(0, len(lengths), RUN)]
        self.runs[first : last + 1] = new
        if not self.runs:
            self.runs = new = [([], [])]
        rows = np.array([[sum(a), len(a), sum(b)] for a, b in new], dtype=np.int64).reshape(-1, 3)
        self.build(np.concatenate([self.levels[0][:first], rows, self.levels[0][last + 1 :]]), first)


def _numbers(x) -> list[int]:
    return x.tolist() if isinstance(x, np.ndarray) else x


class Document:
    """A text with its tree; ``encoded`` is how many pre-tokens the edits have had encoded."""

    def __init__(self, text: str, counter: Counter, tree: bytes | None = None):
        self.text, self.counter, self.encoded = text, counter, 0
        if tree is not None:
            self.tree = Tree.unpacked(tree)
            return
        parts = counter.split(text)
        self.tree = Tree([len(p) for p in parts], counter.counts(parts))

    def edit(self, start: int, end: int, new: str) -> None:
        n = len(self.text)
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # the first pre-token whose end, and what it sees beyond, reaches the edit
        run, at = self.tree.find(max(0, start - SIGHT))
        while run > 0 and at > start - SIGHT:
            run -= 1
            at -= int(self.tree.levels[0][run][0])
        lengths, counts = map(_numbers, self.tree.runs[run])
        k, place = 0, at
        while k < len(lengths) and place + lengths[k] <= start - SIGHT:
            place += lengths[k]
            k += 1
        # old boundaries from the edit's end on, in places of the new text
        last, j, old = run, k, place
        parts: list[str] = []
        done = place

        def forward(limit: int) -> None:
            nonlocal last, j, old
            while old < limit:
                if j >= len(self.tree.runs[last][0]):
                    if last + 1 >= len(self.tree.runs):
                        return
                    last, j = last + 1, 0
                    continue
                old += int(self.tree.runs[last][0][j])
                j += 1

        for m in self.counter.finditer(text, place):
            parts.append(m[0])
            done = m.end()
            if done - shift >= end and done >= start + len(new):
                forward(done - shift)
                if old == done - shift:
                    break
        else:
            forward(n)
        found = self.counter.counts(parts)
        self.encoded += len(parts)
        tail = [_numbers(x) for x in self.tree.runs[last]]
        self.tree.replace(run, last, lengths[:k] + [len(p) for p in parts] + tail[0][j:], counts[:k] + found + tail[1][j:])
        self.text = text


def read_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


EDITS = "array<struct<first: int, last: int, text: string>>"
COUNTS = ["n_chars", "n_pretokens", "n_tokens"]


def _batches(rows: list, first, names: list[str], kinds: list):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([first, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def build_trees(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, text (null: empty), tree, n_chars, n_pretokens, n_tokens of every document."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches):
        counter = Counter(sent.value)
        for batch in batches:
            for part in (batch.slice(k, AT_ONCE) for k in range(0, batch.num_rows, AT_ONCE)):
                rows = []
                for x in part.column(1):
                    d = Document(x.as_py() or "", counter)
                    rows.append([d.text, d.tree.packed(), *d.tree.total.tolist()])
                yield _batches(rows, part.column(0), [key, text, "tree", *COUNTS], [pa.string(), pa.binary(), *[pa.int64()] * 3])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {text} string, tree binary, " + ", ".join(f"{n} long" for n in COUNTS))


def apply_edits(stored: DataFrame, edits: Column, tokenizer: str = TOKENIZER, text: str = "text", key: str = "doc_id", keep: bool = True) -> DataFrame:
    """key, n_chars, n_pretokens, n_tokens of the stored rows, and after ``edits`` (an array of EDITS): n_edits, n_chars_after,
    n_pretokens_after, n_tokens_after, n_reencoded (pre-tokens encoded); and, if asked to ``keep``, the new text and tree.

    What the edits don't touch is not encoded: its counts come from the stored tree."""
    import pyarrow as pa

    names = [*COUNTS, "n_edits", *[f"{n}_after" for n in COUNTS], "n_reencoded"]
    sent = stored.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches):
        counter = Counter(sent.value)
        for batch in batches:
            for part in (batch.slice(k, AT_ONCE) for k in range(0, batch.num_rows, AT_ONCE)):
                rows = []
                for x, tree, e in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    d = Document(x.as_py() or "", counter, tree.as_py())
                    before, changes = d.tree.total.tolist(), e.as_py() or ()
                    for c in changes:
                        d.edit(c["first"], c["last"], c["text"] or "")
                    rows.append([*before, len(changes), *d.tree.total.tolist(), d.encoded, *([d.text, d.tree.packed()] if keep else ())])
                yield _batches(rows, part.column(0), [key, *names, *(["text", "tree"] if keep else ())], [*[pa.int64()] * 8, *([pa.string(), pa.binary()] if keep else ())])

    rows = stored.select(key, text, "tree", edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, f"{key} {stored.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", text string, tree binary" * keep)


def count_tokens(docs: DataFrame, edits: Column | None = None, tokenizer: str = TOKENIZER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Trees of all documents, then the edits on them: what ``apply_edits`` returns, without texts and trees."""
    stored = build_trees(docs, tokenizer, text, key)
    return apply_edits(stored, edits if edits is not None else F.lit(None), tokenizer, text, key, keep=False)
