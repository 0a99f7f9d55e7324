"""Media columns: ISO media containers (boxes) written and read without decoding payloads.

``walk`` goes through nested boxes of any ISO base media file (32- and 64-bit sizes, size 0 for "to the end", uuid
boxes, full boxes of version 0 and 1, at most DEEPEST in one another); ``describe`` decodes the sample tables (stts, stsc, stsz or stz2, stco
or co64, stss) and the fragments (trex, tfhd, trun) of each track into sample byte ranges and gives codec, duration and
the byte ranges of keyframes. Broken files give status ``error`` and a message, never an exception; what a table claims
is compared with the file's size before memory is taken for it. ``wrap`` stores bytes as a track of 8-bit samples, with
the same output for equal input (all times are 0).

Nulls: a null text counts as empty, a null container gives status ``error``; null ids are carried on. Repeated rows give
repeated results, an empty table an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

#: Boxes whose content is boxes (fixed values).
CONTAINERS = frozenset(b"moov trak mdia minf stbl dinf edts udta mvex moof traf mfra".split())
#: Bytes of a stored frame, frames from one keyframe to the next, and frames of a chunk.
FRAME, GOP, CHUNK = 1024, 8, 16
RATE = 8000
UNIT = 64
#: Boxes in one another; real files have some ten.
DEEPEST = 64


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _list(values, code: str = "I") -> bytes:
    return struct.pack(f">I{len(values)}{code}", len(values), *values)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    """The data with zero bytes up to a positive multiple of UNIT."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wrap(payload: bytes) -> bytes:
    """An ISO media file with one mono track of unsigned 8-bit samples; frames of FRAME samples, GOP to a keyframe."""
    n = len(payload)
    sizes = [FRAME] * (n // FRAME) + ([n % FRAME] if n % FRAME else [])
    frames = len(sizes)
    wide = n >= 1 << 31
    times = [(n // FRAME, FRAME)] * (n >= FRAME) + [(1, n % FRAME)] * bool(n % FRAME)
    chunks = -(-frames // CHUNK)
    runs = [(1, CHUNK, 1)] * (frames >= CHUNK) + ([(frames // CHUNK + 1, frames % CHUNK, 1)] if frames % CHUNK else [])
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(start: int) -> bytes:
        at = [start + k * CHUNK * FRAME for k in range(chunks)]
        stbl = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">I", len(times)), *[struct.pack(">II", *x) for x in times]),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *x) for x in runs]), _full(b"stsz", struct.pack(">I", 0), _list(sizes)),
            _full(b"co64", _list(at, "Q")) if wide else _full(b"stco", _list(at)), _full(b"stss", _list(range(1, frames + 1, GOP))),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        # version 1: 64-bit times
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, n, 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    start = len(ftyp) + len(moov(0)) + (16 if n + 8 >= 1 << 32 else 8)
    return b"".join((ftyp, moov(start), _box(b"mdat", payload)))


def walk(data: bytes) -> Iterator[tuple[tuple, int, int, int]]:
    """(path, start, start of content, end) of every box, parents first."""
    waiting = [(0, len(data), ())]
    while waiting:
        at, end, path = waiting.pop()
        if at >= end:
            continue
        if end - at < 8:
            raise ValueError(f"{end - at} stray bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        head += 16 * (kind == b"uuid")
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has the size {size}")
        if len(path) >= DEEPEST:
            raise ValueError(f"more than {DEEPEST} boxes in one another")
        yield (own := (*path, kind)), at, at + head, at + size
        waiting.append((at + size, end, path))
        if kind in CONTAINERS:
            waiting.append((at + head, at + size, own))


def _numbers(data: bytes, at: int, end: int, code: str, per: int = 1) -> np.ndarray:
    n = struct.unpack_from(">I", data, at)[0]
    size = struct.calcsize(f">{code}")
    if at + 4 + n * per * size > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, f">u{size}", n * per, at + 4).astype(np.int64)


def _sizes(data: bytes, at: int, end: int, compact: bool) -> np.ndarray:
    same, n = struct.unpack_from(">II", data, at + 4)
    if compact:
        bits = same & 255
        if bits not in (4, 8, 16) or n * bits > 8 * (end - at - 12):
            raise ValueError("a table is longer than its box")
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, -(-n // 2), at + 12)
            return np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n].astype(np.int64)
        return np.frombuffer(data, f">u{bits // 8}", n, at + 12).astype(np.int64)
    if same:
        if n * same > len(data):
            raise ValueError("samples are longer than the file")
        return np.full(n, same, dtype=np.int64)
    if 4 * n > end - at - 12:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)


def _run(data: bytes, at: int, end: int, fragment: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, sizes, durations and key marks of a trun box's samples; ``fragment`` has the defaults and the next byte."""
    flags, n = struct.unpack_from(">II", data, at)
    place = at + 8
    if flags & 1:
        fragment["next"] = fragment["base"] + struct.unpack_from(">i", data, place)[0]
        place += 4
    first = struct.unpack_from(">I", data, place)[0] if flags & 4 else None
    place += 4 * (flags & 4 > 0)
    names = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if place + 4 * len(names) * n > end:
        raise ValueError("a table is longer than its box")
    fragment["left"][0] -= n
    if fragment["left"][0] < 0:
        raise ValueError("more samples than bytes")
    rows = np.frombuffer(data, ">u4", n * len(names), place).reshape(n, len(names)).astype(np.int64)
    field = {name: rows[:, names.index(name)] if name in names else np.full(n, fragment[name], dtype=np.int64) for name in ("duration", "size", "flags")}
    if first is not None and n and "flags" not in names:
        field["flags"][0] = first
    offsets = fragment["next"] + np.cumsum(field["size"]) - field["size"]
    fragment["next"] += int(field["size"].sum())
    if n and (offsets[0] < 0 or fragment["next"] > len(data)):
        raise ValueError("a sample lies beyond the end")
    return offsets, field["size"], field["duration"], field["flags"] & 0x10000 == 0


def _tracks(data: bytes) -> list[dict]:
    none = np.zeros(0, np.int64)
    tracks: list[dict] = []
    defaults: dict[int, tuple] = {}
    fragment: dict = {}
    moof, left = 0, [len(data)]  # runs may claim samples without a byte of their own: as many as the file has bytes, together
    for path, start, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"id": 0, "handler": "", "codec": "", "timescale": 0, "duration": 0, "times": none, "runs": none, "sizes": none, "chunks": none, "keys": None, "fragments": []})
        elif kind == b"trex":
            number, _, *rest = struct.unpack_from(">5I", data, at + 4)
            defaults[number] = tuple(rest)
        elif kind == b"moof":
            moof = start
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">II", data, at)
            own = next((t for t in tracks if t["id"] == number), None)
            if own is None:
                raise ValueError(f"a fragment of an unknown track {number}")
            # the second track of a fragment goes on where the first ended, unless it says otherwise
            base = moof if flags & 0x20000 or fragment.get("moof") != moof else fragment["next"]
            place = at + 8
            if flags & 1:
                base, place = struct.unpack_from(">Q", data, place)[0], place + 8
            place += 4 * (flags & 2 > 0)
            found = list(defaults.get(number, (0, 0, 0)))
            for k, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    found[k] = struct.unpack_from(">I", data, place)[0]
                    place += 4
            fragment = {"track": own, "moof": moof, "base": base, "next": base, "left": left} | dict(zip(("duration", "size", "flags"), found, strict=True))
        elif kind == b"trun" and b"moof" in path:
            if fragment.get("moof") != moof:
                raise ValueError("a run of samples without a header")
            fragment["track"]["fragments"].append(_run(data, at, end, fragment))
        if b"trak" not in path or not tracks:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            t["id"] = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        elif kind == b"hdlr":
            t["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        elif kind == b"stsd" and end - at >= 16:
            t["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif kind == b"stts":
            t["times"] = _numbers(data, at + 4, end, "I", 2)
        elif kind == b"stsc":
            t["runs"] = _numbers(data, at + 4, end, "I", 3)
        elif kind in (b"stsz", b"stz2"):
            t["sizes"] = _sizes(data, at, end, kind == b"stz2")
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _numbers(data, at + 4, end, "I" if kind == b"stco" else "Q")
        elif kind == b"stss":
            t["keys"] = _numbers(data, at + 4, end, "I")
    return tracks


def samples(track: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of all samples, from chunk offsets, samples per chunk and sample sizes."""
    runs, chunks, sizes = track["runs"].reshape(-1, 3), track["chunks"], track["sizes"]
    bounds = np.append(runs[:, 0] - 1, len(chunks))
    if len(runs) and (bounds[0] != 0 or (np.diff(bounds) < 0).any()):
        raise ValueError("chunks of samples out of order")
    each = np.repeat(runs[:, 1], np.diff(bounds))
    if int(each.sum()) != len(sizes) or len(each) != len(chunks):
        raise ValueError(f"chunks hold {int(each.sum())} of {len(sizes)} samples")
    ends = np.concatenate([[0], np.cumsum(sizes)])
    first = np.cumsum(each) - each
    offsets = ends[:-1] - np.repeat(ends[first], each) + np.repeat(chunks, each)
    if len(offsets) and (offsets.min() < 0 or (offsets + sizes).max() > length):
        raise ValueError("a sample lies beyond the end")
    return offsets, sizes


def describe(data: bytes | None) -> dict:
    """status, error and, per track: codec, handler, timescale, duration, samples (offset, size), keyframes' byte ranges."""
    if data is None:
        return {"status": "error", "error": "no file", "tracks": []}
    try:
        tracks = []
        for t in _tracks(data):
            offsets, sizes = samples(t, len(data))
            key = np.full(len(offsets), t["keys"] is None)
            if t["keys"] is not None:
                if len(t["keys"]) and not 1 <= t["keys"].min() <= t["keys"].max() <= len(offsets):
                    raise ValueError("a keyframe that no sample is")
                key[t["keys"] - 1] = True
            time = int((t["times"][::2] * t["times"][1::2]).sum())
            for o, n, d, k in t["fragments"]:
                offsets, sizes, key, time = np.concatenate([offsets, o]), np.concatenate([sizes, n]), np.concatenate([key, k]), time + int(d.sum())
            ranges = np.stack([offsets, offsets + sizes], axis=1)[key].tolist()
            tracks.append({k: t[k] for k in ("codec", "handler", "timescale", "duration")} | {"samples": np.stack([offsets, sizes], axis=1), "sample_time": time, "keyframes": [tuple(x) for x in ranges]})
        return {"status": "ok", "error": "", "tracks": tracks}
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        return {"status": "error", "error": str(e) or type(e).__name__, "tracks": []}


def payload_of(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples, in order."""
    view = memoryview(data)
    return b"".join([view[a : a + n] for a, n in track["samples"].tolist()])


def probe(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, status, error, track, codec, handler, timescale, duration, samples, keyframe ranges of binary containers."""
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()
    ranges = pa.list_(pa.struct([("first_byte", pa.int64()), ("end_byte", pa.int64())]))
    names = ["status", "error", "track", "codec", "handler", "timescale", "duration", "n_samples"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows: list = []
            ids = []
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                found = describe(data.as_py())
                for i, t in enumerate(found["tracks"] or [None]):
                    ids.append(k.as_py())
                    rows.append((found["status"], found["error"], i, *((t[x] for x in ("codec", "handler", "timescale", "duration")) if t else [None] * 4), len(t["samples"]) if t else None, [{"first_byte": a, "end_byte": b} for a, b in t["keyframes"]] if t else []))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *[pa.array(c, t) for c, t in zip(columns, [*kinds, ranges], strict=True)]], [key, *names, "keyframes"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, status string, error string, track int, codec string, handler string, timescale long, duration long, n_samples long, keyframes array<struct<first_byte: long, end_byte: long>>")


def store_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_media: bool = False) -> DataFrame:
    """Each text as an ISO media file, read back: sizes, checksums and the track's features (and the file itself)."""
    import pyarrow as pa

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, timescale long, duration long, n_samples long, n_keyframes long, feature string"

    def one(data: bytes) -> tuple:
        media = wrap(padded(data))
        found = describe(media)
        track = found["tracks"][0]
        back = payload_of(media, track)
        ranges = ",".join(f"{a}-{b}" for a, b in track["keyframes"])
        feature = f"codec={track['codec'].strip()};timescale={track['timescale']};duration={track['duration']};samples={len(track['samples'])};keyframes={ranges}"
        out = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), track["codec"].strip(), track["timescale"], track["duration"], len(track["samples"]), len(track["keyframes"]), feature)
        return (*out, media) if keep_media else out

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_media
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "timescale", "duration", "n_samples", "n_keyframes", "feature"] + ["media"] * keep_media

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):  # so few files at once
                part = batch.slice(k, 500)
                rows = [one(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], [key, *names])

    return docs.select(key, text).mapInArrow(run, schema + ", media binary" * keep_media)
