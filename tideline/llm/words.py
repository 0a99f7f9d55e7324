"""Vectorised word kernels over UTF-8 bytes, shared by the operators of this folder.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D (the contract's ``[^\\x20\\x09-\\x0D]+``),
after lower-casing A-Z. Words are known by 64-bit hashes; two different words of a corpus of a billion
distinct words collide with a probability of about 3 per cent in total. Texts are hashed in pieces of
PIECE bytes that end at word ends, and of ROWS rows at most, so memory follows neither the batch nor its shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes and rows hashed at once.
PIECE = 1 << 18
ROWS = 1 << 10
#: Odd multipliers (fixed values): the powers of STEP weigh the bytes of a word, FOLD those of a shingle's words.
STEP = 0x9E3779B97F4A7C15
FOLD = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalises uint64 hashes: each output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


_TABLES: dict = {}


def _tables(n: int) -> tuple:
    """Byte values after lower-casing, their codes, white space, and powers of STEP and of its inverse."""
    if _TABLES.get("n", 0) < n:
        n = max(n, PIECE + 4096)
        byte = np.arange(256, dtype=np.uint8)
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
        space = (byte == 32) | ((byte >= 9) & (byte <= 13))
        code = mixed(lower.astype(np.uint64) * np.uint64(STEP) + np.uint64(1))
        _TABLES.update(n=n, code=code, space=space, up=_powers(STEP, n), down=_powers(pow(STEP, -1, 1 << 64), n))
    return _TABLES["code"], _TABLES["space"], _TABLES["up"], _TABLES["down"]


def piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in one array of bytes."""
    code, space, up, down = _tables(len(data) + 1)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~space[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(code[data] * up[: len(data)], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), starts, ends


def cuts(data: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that end at white space; one huge word stays whole."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n:
            gap = np.flatnonzero(space[data[max(at, end - 4096) : end]])
            if len(gap):
                end = max(at, end - 4096) + int(gap[-1]) + 1
                break
            end = min(n, end + 4096)
        yield at, end
        at = end


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow string column; nulls count as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of at most ROWS rows with at most ``most`` bytes together, or a single longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(n, end, at + ROWS)
        yield at, end
        at = end


def row_words(column, most: int = PIECE, tags=None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, word offsets by row) of consecutive rows.

    ``tags(hashes, ends)`` may change the hashes; ``ends`` has a number for the first and the last two bytes of each word.
    """
    data, offsets = buffers(column)

    def hashed(part):
        hashes, starts, ends = piece_words(part)
        if tags is not None and len(hashes):
            code = _tables(1)[0]
            hashes = tags(hashes, code[part[starts]] + np.uint64(3) * code[part[ends - 1]] + np.uint64(5) * code[part[np.maximum(ends - 2, starts)]])
        return hashes, starts

    for a, b in runs(offsets, most):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a == 1:
            space = _tables(1)[1]
            parts = [hashed(data[lo + s : lo + e])[0] for s, e in cuts(data[lo:hi], space)]
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield a, b, hashes, np.array([0, len(hashes)])
        else:  # a separator between rows keeps words apart
            lengths = np.diff(offsets[a : b + 1])
            own = offsets[a : b + 1] - lo + np.arange(b - a + 1)
            joined = np.full(hi - lo + b - a, 32, dtype=np.uint8)
            joined[np.arange(hi - lo) + np.repeat(np.arange(b - a), lengths)] = data[lo:hi]
            hashes, starts = hashed(joined)
            yield a, b, hashes, np.searchsorted(starts, own)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words; empty if there are fewer."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(FOLD) + hashes[k : k + n]
    return mixed(out)


def row_shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all rows, in order; a row with 1 to size - 1 words has one shingle, its whole sequence."""
    counts = np.diff(offsets)
    whole = shingles(hashes, size)
    row_of = np.repeat(np.arange(len(counts)), counts)
    keep = np.zeros(0, bool)
    if len(whole):
        keep = row_of[: len(whole)] == row_of[size - 1 :]
    rows, values = row_of[: len(whole)][keep], whole[keep]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([_whole(hashes[offsets[r] : offsets[r + 1]], size) for r in short], dtype=np.uint64)
        rows, values = np.concatenate([rows, short]), np.concatenate([values, extra])
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    return rows, values


def _whole(hashes: np.ndarray, size: int) -> int:
    h = len(hashes) + 0x51ED27  # apart from the shingles of full size
    for x in hashes.tolist():
        h = (h * FOLD + x) & _MASK
    return int(mixed(np.array([h], dtype=np.uint64))[0])


def row_sets(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the offsets by row."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(n + 1))
