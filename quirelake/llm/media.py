"""Media columns: ISO base-media containers read without decoding their payloads.

A reader walks the nested boxes of a container, decodes the sample tables of each track
and gives codec, duration and the byte ranges of its keyframes; payload bytes are only
copied, never decoded. A small writer stores bytes losslessly as 8-bit audio samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import python_batches, values

#: Boxes that hold boxes, with the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
#: The writer's layout: bytes of a sample, samples of a chunk, samples from one keyframe to the next, ticks a second.
SAMPLE, CHUNK, KEY_EVERY, RATE = 64, 1024, 256, 8000


class MediaError(ValueError):
    """The bytes are not a container that the reader can follow."""


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(depth, type, body start, end, start) of every box, a parent before its children, however deep they are nested."""
    ends = [len(data) if end is None else end]  # of the boxes that are open
    while ends:
        end = ends[-1]
        if start >= end:
            ends.pop()
            continue
        if end - start < 8:
            raise MediaError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MediaError(f"large size cut off at {start}")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise MediaError(f"box at {start} has size {size}")
        yield len(ends) - 1, kind, body, start + size, start
        if kind in CONTAINERS:
            ends.append(start + size)
            start = min(body + CONTAINERS[kind], start + size)
        else:
            start += size


@dataclass
class Track:
    """One track: sample offsets and sizes in file order of the samples, and which samples are keyframes."""

    codec: str
    handler: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, length) of each keyframe."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist()))

    def payload(self, data: bytes) -> bytes:
        """The bytes of all samples in order; neighbouring samples are copied together."""
        if not len(self.offsets):
            return b""
        ends = self.offsets + self.sizes
        first = np.flatnonzero(np.concatenate([[True], self.offsets[1:] != ends[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(ends) - 1]])
        return b"".join(data[a:b] for a, b in zip(self.offsets[first].tolist(), ends[last].tolist()))


def _entries(data: bytes, body: int, end: int, width: int, dtype: str = ">u4") -> np.ndarray:
    """Rows of a full box whose body is a count and ``width`` numbers a row."""
    if end - body < 8:
        raise MediaError("table cut off")
    n = struct.unpack_from(">I", data, body + 4)[0]
    if body + 8 + n * width * np.dtype(dtype).itemsize > end:
        raise MediaError("table longer than its box")
    return np.frombuffer(data, dtype, n * width, body + 8).astype(np.int64).reshape(n, width)


def _sizes(data: bytes, kind: bytes, body: int, end: int) -> np.ndarray:
    if end - body < 12:
        raise MediaError("size table cut off")
    if kind == b"stsz":
        fixed, n = struct.unpack_from(">II", data, body + 4)
        if fixed:
            if fixed * n > len(data):
                raise MediaError("samples longer than the file")
            return np.full(n, fixed, np.int64)
        bits = 32
    else:
        bits, n = data[body + 7], struct.unpack_from(">I", data, body + 8)[0]
    if bits not in (4, 8, 16, 32) or body + 12 + (n * bits + 7) // 8 > end:
        raise MediaError("size table longer than its box")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, body + 12)
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, body + 12).astype(np.int64)


def _offsets(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Offset of each sample from chunk offsets and (first chunk, samples a chunk, description) runs."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    if not len(runs) or runs[0, 0] != 1:
        raise MediaError("no chunk run starts at chunk 1")
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if (spans < 0).any():
        raise MediaError("chunk runs out of order")
    each = np.repeat(runs[:, 1], spans)
    if int(each.sum()) != n:
        raise MediaError(f"chunks hold {int(each.sum())} samples, the size table {n}")
    upto = np.cumsum(sizes) - sizes
    first = np.cumsum(each) - each
    starts = np.where(each > 0, upto[np.minimum(first, n - 1)], 0)
    return np.repeat(chunks - starts, each) + upto


#: Flags of track fragments and of their runs, and the flag of a sample that is no keyframe.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, FIRST_FLAGS, RUN_FIELDS = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800)
NOT_SYNC = 0x10000


class _Fields:
    """Numbers of a full box, one after another; reading past its end is an error."""

    def __init__(self, data: bytes, body: int, end: int):
        self.data, self.at, self.end = data, body, end
        self.flags = self.take(">I") & 0xFFFFFF

    def take(self, form: str, given: int = 1) -> int:
        """The next number, or 0 where a flag says that it isn't there."""
        if not given:
            return 0
        if self.at + struct.calcsize(form) > self.end:
            raise MediaError("fields cut off")
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return value


@dataclass
class _Fragment:
    """A track fragment: its track, where its data begin, and its defaults for duration, size and flags."""

    track: int
    base: int
    defaults: tuple[int, int, int]


class _Fragments:
    """Samples that movie fragments add to tracks: arrays of offsets, sizes, keyframe flags and durations by track number."""

    def __init__(self) -> None:
        self.defaults: dict[int, tuple[int, int, int]] = {}
        self.runs: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.moof = self.next = 0
        self.open: _Fragment | None = None

    def extends(self, f: _Fields) -> None:
        track, _ = f.take(">I"), f.take(">I")
        self.defaults[track] = (f.take(">I"), f.take(">I"), f.take(">I"))

    def movie(self, start: int) -> None:
        self.moof = self.next = start

    def track(self, f: _Fields) -> None:
        track = f.take(">I")
        base = f.take(">Q") if f.flags & BASE_OFFSET else self.moof if f.flags & BASE_IS_MOOF else self.next
        f.take(">I", f.flags & DESCRIPTION)
        known = self.defaults.get(track, (0, 0, 0))
        self.open = _Fragment(track, base, tuple(f.take(">I") if f.flags & flag else old for flag, old in zip((DURATION, SIZE, FLAGS), known)))
        self.next = base

    def run(self, f: _Fields) -> None:
        if self.open is None:
            raise MediaError("a run outside of a track fragment")
        n = f.take(">I")
        start = self.open.base + f.take(">i") if f.flags & RUN_OFFSET else self.next
        first = f.take(">I", f.flags & FIRST_FLAGS)
        present = [flag for flag in RUN_FIELDS if f.flags & flag]
        if f.at + 4 * n * len(present) > f.end or (not present and n > len(f.data)):
            raise MediaError("run longer than its box")
        table = np.frombuffer(f.data, ">u4", n * len(present), f.at).reshape(n, len(present)).astype(np.int64)
        column = {flag: table[:, k] for k, flag in enumerate(present)}
        duration, size, flags = (column.get(flag, np.full(n, old, np.int64)) for flag, old in zip(RUN_FIELDS, self.open.defaults))
        if f.flags & FIRST_FLAGS and n:
            flags = np.concatenate([[first], flags[1:]])
        self.runs.setdefault(self.open.track, []).append((start + np.cumsum(size) - size, size, flags & NOT_SYNC == 0, duration))
        self.next = start + int(size.sum())


def probe(data: bytes) -> list[Track]:
    """The tracks of a container, fragments included; raises MediaError where boxes or tables don't fit."""
    tracks: list[dict] = []
    fragments = _Fragments()
    for depth, kind, body, end, start in boxes(data):
        if kind == b"trak":
            tracks.append({})
        elif kind == b"moof":
            fragments.movie(start)
        elif kind == b"trex":
            fragments.extends(_Fields(data, body, end))
        elif kind == b"tfhd":
            fragments.track(_Fields(data, body, end))
        elif kind == b"trun":
            fragments.run(_Fields(data, body, end))
        elif not tracks or depth < 2:
            continue
        elif kind == b"tkhd":
            f = _Fields(data, body, end)
            form = ">Q" if data[body] == 1 else ">I"
            f.take(form), f.take(form)
            tracks[-1]["number"] = f.take(">I")
        elif kind == b"mdhd":
            wide = end > body and data[body] == 1
            need = 32 if wide else 20
            if end - body < need:
                raise MediaError("media header cut off")
            tracks[-1]["time"] = struct.unpack_from(">IQ" if wide else ">II", data, body + (20 if wide else 12))
        elif kind == b"hdlr" and end - body >= 12:
            tracks[-1].setdefault("handler", data[body + 8 : body + 12].decode("latin-1"))
        elif kind == b"stsd":
            if end - body < 16:
                raise MediaError("sample description cut off")
            tracks[-1]["codec"] = data[body + 12 : body + 16].decode("latin-1")
        elif kind in (b"stsz", b"stz2"):
            tracks[-1]["sizes"] = _sizes(data, kind, body, end)
        elif kind == b"stsc":
            tracks[-1]["runs"] = _entries(data, body, end, 3)
        elif kind == b"stco":
            tracks[-1]["chunks"] = _entries(data, body, end, 1)[:, 0]
        elif kind == b"co64":
            tracks[-1]["chunks"] = _entries(data, body, end, 1, ">u8")[:, 0]
        elif kind == b"stts":
            tracks[-1]["ticks"] = _entries(data, body, end, 2)
        elif kind == b"stss":
            tracks[-1]["sync"] = _entries(data, body, end, 1)[:, 0]
    if strays := fragments.runs.keys() - {t.get("number") for t in tracks}:
        raise MediaError(f"fragments of tracks that there are not: {sorted(strays)}")
    out = []
    for t in tracks:
        missing = {"codec", "time", "sizes", "runs", "chunks"} - t.keys()
        if missing:
            raise MediaError(f"a track lacks {', '.join(sorted(missing))}")
        sizes = t["sizes"]
        offsets = _offsets(sizes, t["chunks"], t["runs"])
        keys = t["sync"] - 1 if "sync" in t else np.arange(len(sizes))
        if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
            raise MediaError("keyframe beyond the samples")
        ticks = t.get("ticks")
        duration = int((ticks[:, 0] * ticks[:, 1]).sum()) if ticks is not None and len(ticks) else int(t["time"][1])
        for more_offsets, more_sizes, is_key, durations in fragments.runs.get(t.get("number"), []):
            keys = np.concatenate([keys, len(sizes) + np.flatnonzero(is_key)])
            offsets, sizes = np.concatenate([offsets, more_offsets]), np.concatenate([sizes, more_sizes])
            duration += int(durations.sum())
        if len(sizes) and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
            raise MediaError("samples beyond the end")
        out.append(Track(t["codec"], t.get("handler", ""), int(t["time"][0]), duration, offsets, sizes, keys))
    return out


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def mux(payload: bytes) -> bytes:
    """A container with one audio track whose samples of SAMPLE bytes, one after another, are the payload.

    The payload's length must be a positive multiple of SAMPLE. Equal payloads give equal bytes.
    """
    n = len(payload) // SAMPLE
    if n < 1 or n * SAMPLE != len(payload):
        raise MediaError(f"a payload needs a positive multiple of {SAMPLE} bytes")
    chunks, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    keys = range(1, n + 1, KEY_EVERY)
    ticks = n * SAMPLE
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))

    def head(first: int) -> bytes:
        at = [first + k * CHUNK * SAMPLE for k in range(len(runs) and chunks + bool(rest))]
        wide = at[-1] >= 1 << 32
        offsets = _full(b"co64" if wide else b"stco", struct.pack(f">I{len(at)}{'Q' if wide else 'I'}", len(at), *at))
        tables = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, SAMPLE)), _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]), _full(b"stsz", struct.pack(">II", SAMPLE, n)), offsets,
        )
        info = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), tables)
        media = _box(b"mdia", _box(b"mdhd", struct.pack(">IQQIQI", 1 << 24, 0, 0, RATE, ticks, 0x55C40000)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), info)
        track = _box(b"trak", _box(b"tkhd", struct.pack(">IQQIIQ", (1 << 24) | 7, 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8)), media)
        movie = _box(b"mvhd", struct.pack(">IQQIQIH", 1 << 24, 0, 0, RATE, ticks, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2") + _box(b"moov", movie, track)

    large = len(payload) + 8 >= 1 << 32
    lead = 16 if large else 8
    size = len(head(0))
    start = head(size + lead)
    if len(start) != size:  # offsets became wide
        start = head(len(start) + lead)
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if large else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return start + data + payload


def padded(raw: bytes) -> tuple[int, bytes]:
    """Length of a payload, and its bytes with zeros up to a positive multiple of SAMPLE."""
    return len(raw), raw + bytes(-len(raw) % SAMPLE or (SAMPLE if not raw else 0))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each whole text, padded, as a container.

    Null texts count as empty ones, which store SAMPLE zero bytes. The bytes are stored as
    they stand, be they valid UTF-8 or not. Repeated rows stay; ids keep their type; other
    columns are ignored whatever their names. An empty table gives an empty result.
    """
    python_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rows = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([mux(p) for _, p in rows], pa.binary())], names=["id", "n_bytes", "media"])

    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    return raw.mapInArrow(step, f"id {raw.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


TRACK = pa.struct(
    [
        ("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ]
)
TRACK_SQL = "struct<codec:string,handler:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<offset:long,length:long>>,payload_bytes:long,payload_sha256:string,tail_crc32:long>"


def probe_media(media: DataFrame) -> DataFrame:
    """``id, n_bytes, tracks, media_bytes, media_sha256, error``: one row for each row of ``id, n_bytes, media``.

    ``tracks`` has for every track what its tables say and digests of its stored bytes. A
    null or broken container, or one without a track, has null tracks and its ``error``;
    its length and digest are still given. Ids keep their type; repeated rows stay; other
    columns are ignored whatever their names.
    """
    python_batches(media.sparkSession)

    def of_track(t: Track, data: bytes) -> dict:
        stored = t.payload(data)
        keys = [{"offset": a, "length": b} for a, b in t.keyframes()]
        return {"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": keys, "payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-64:])}

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, "no bytes"
        whole = (len(data), hashlib.sha256(data).hexdigest())
        try:
            tracks = probe(data)
            if not tracks:
                raise MediaError("no track")
        except MediaError as e:
            return None, *whole, str(e)
        return [of_track(t, data) for t in tracks], *whole, None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in values(batch.column(2))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.list_(TRACK), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", "n_bytes", "tracks", "media_bytes", "media_sha256", "error"])

    kept = media.select("id", "n_bytes", "media")
    return kept.mapInArrow(step, f"id {kept.schema['id'].dataType.simpleString()}, n_bytes long, tracks array<{TRACK_SQL}>, media_bytes long, media_sha256 string, error string")
