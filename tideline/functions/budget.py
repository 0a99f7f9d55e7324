"""Token budgets of texts, by a byte-pair vocabulary whose file is a parameter."""

from __future__ import annotations

import base64
import heapq

from pyspark.sql import DataFrame

#: Split pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def cut(text: str, budget: int, coder) -> tuple[str, int, bool]:
    """(text, tokens before, cut): at most ``budget`` tokens of the text."""
    tokens = coder.encode_ordinary(text)
    return (coder.decode(tokens[:budget]).rstrip() if len(tokens) > budget else text.strip()), len(tokens), len(tokens) > budget


def cut_slots(slots: list[str], budget: int, coder) -> tuple[list[str], int, bool]:
    """(slots, tokens before, cut): the longest slot, the first among equals, loses tokens until the lines fit together."""
    slots = [s.strip() for s in slots]
    before = len(coder.encode_ordinary("\n".join(slots)))
    if before <= budget:
        return slots, before, False
    tokens = [coder.encode_ordinary(s) for s in slots]
    longest = [(-len(t), k) for k, t in enumerate(tokens)]
    heapq.heapify(longest)
    while len(coder.encode_ordinary("\n".join(map(coder.decode, tokens)))) > budget:
        n, k = heapq.heappop(longest)
        if not n:
            raise ValueError("the budget can't hold the separators")
        tokens[k].pop()
        heapq.heappush(longest, (n + 1, k))
    return [coder.decode(t).rstrip() for t in tokens], before, True


def budgeted(df: DataFrame, key: str, slots: str, budget: int, vocabulary: str) -> DataFrame:
    """(key, slots, tokens_before, cut) of rows with an array of texts; one slot is cut at its end."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # the vocabulary's fixed size

    def run(frames):
        import pandas as pd

        coder = encoder(sent.value)
        for f in frames:
            out = []
            for k, texts in zip(f[key], f[slots]):
                texts = [t or "" for t in (texts if texts is not None else ())]
                if len(texts) == 1:
                    t, n, c = cut(texts[0], budget, coder)
                    out.append((k, [t], n, c))
                else:
                    out.append((k, *cut_slots(texts, budget, coder)))
            yield pd.DataFrame(out, columns=[key, "slots", "tokens_before", "cut"])

    return df.select(key, slots).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, slots array<string>, tokens_before long, cut boolean")
