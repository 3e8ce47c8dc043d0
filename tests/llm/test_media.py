import hashlib
import struct
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, edge_rows, edge_table
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import media
from quirelake.llm.queries import op1_media_columns


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
    data = media.mux(payload)
    (track,) = media.probe(data)
    assert track.payload(data) == payload
    assert (track.codec, track.handler, track.timescale, track.duration) == ("raw ", "soun", media.RATE, len(payload))
    assert all(data[a : a + n] == payload[64 * k : 64 * k + n] for k, (a, n) in zip(range(0, 1 << 20, media.KEY_EVERY), track.keyframes()))
    assert len(track.keyframes()) == -(-len(payload) // 64 // media.KEY_EVERY)


@pytest.mark.parametrize("samples", [1, 255, 256, 257, 1023, 1024, 1025, 5000])
def test_chunks_and_keyframes(samples):
    payload = np.random.default_rng(samples).integers(0, 256, samples * 64, np.uint8).tobytes()
    data = media.mux(payload)
    assert media.probe(data)[0].payload(data) == payload and media.mux(payload) == data


def test_boxes_are_nested():
    kinds = [(d, k) for d, k, *_ in media.boxes(media.mux(bytes(64)))]
    assert (0, b"moov") in kinds and (4, b"stbl") in kinds and (5, b"stsz") in kinds and kinds[-1] == (0, b"mdat")


@pytest.mark.parametrize("cut", range(1, 700, 7))
def test_cut_off_files_are_errors_not_crashes(cut):
    data = media.mux(bytes(range(64)) * 2)[:-cut]
    try:
        media.probe(data)
    except media.MediaError:
        pass


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 600), st.binary(min_size=1, max_size=4))
def test_damaged_files_are_errors_not_crashes(at, noise):
    data = bytearray(media.mux(bytes(range(64)) * 2))
    data[at : at + len(noise)] = noise
    try:
        for t in media.probe(bytes(data)):
            t.payload(bytes(data))
    except media.MediaError:
        pass


def _full(kind, *parts):
    return media._full(kind, *parts)


def test_other_tables():
    """Sample sizes in four bits, 64-bit offsets, several chunk runs, no keyframe table, a box to the end of the file."""
    sizes = [3, 5, 2, 7, 1]
    packed = bytes([3 << 4 | 5, 2 << 4 | 7, 1 << 4])
    entry = media._box(b"avc1", bytes(78))
    tables = media._box(b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">IIIII", 2, 4, 10, 1, 5)), _full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 3, 1)), _full(b"stz2", b"\0\0\0\4", struct.pack(">I", 5), packed), _full(b"co64", struct.pack(">IQQ", 2, 900, 1000)))
    trak = media._box(b"trak", media._box(b"mdia", media._box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 90, 45, 0)), media._box(b"minf", tables)))
    data = media._box(b"moov", trak) + struct.pack(">I4s", 0, b"mdat")
    data += bytes(1100 - len(data))
    (t,) = media.probe(data)
    assert t.sizes.tolist() == sizes and t.offsets.tolist() == [900, 903, 1000, 1002, 1009]
    assert (t.codec, t.duration, t.timescale) == ("avc1", 45, 90) and len(t.keyframes()) == 5


def test_edge_rows(spark):
    rows = media.probe_media(media.store_texts(edge_table(spark))).collect()
    assert len(rows) == len(edge_rows()) and all(r.error is None for r in rows)
    want = {}
    for i, text, *_ in edge_rows():
        n, payload = media.padded((text or "").encode())
        want[i] = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert all((r.n_bytes, r.tracks[0].payload_bytes, r.tracks[0].payload_sha256, r.tracks[0].tail_crc32) == want[r.id] for r in rows)
    assert want[2][:2] == (0, 64)
    assert media.probe_media(media.store_texts(spark.createDataFrame([], SCHEMA))).count() == 0


def test_broken_rows(spark):
    rows = spark.createDataFrame([(1, 3, b"abc"), (2, 0, None), (3, 0, b"")], "id long, n_bytes long, media binary")
    found = {r.id: r for r in media.probe_media(rows).collect()}
    assert all(found[i].error and found[i].tracks is None for i in (1, 2, 3)) and found[1].media_bytes == 3


def track(number, codec, tables):
    head = _full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0))
    media_head = media._box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 90, 0, 0))
    return media._box(b"trak", head, media._box(b"mdia", media_head, _full(b"hdlr", bytes(4), b"vide" if codec == b"avc1" else b"soun"), media._box(b"minf", media._box(b"stbl", _full(b"stsd", struct.pack(">I", 1), media._box(codec, bytes(28))), *tables))))


def plain_tables(sizes, offset, keys):
    return [_full(b"stts", struct.pack(">III", 1, len(sizes), 10)), _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)), _full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), _full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), _full(b"stco", struct.pack(">II", 1, offset))]


def test_every_track_is_given(spark):
    sound, video = [4, 6], [10, 20, 30]
    movie = lambda at: media._box(b"moov", track(1, b"mp4a", plain_tables(sound, at, [1, 2])), track(2, b"avc1", plain_tables(video, at + 10, [1, 3])))
    at = len(movie(0)) + 8
    body = bytes(range(70))
    data = movie(at) + media._box(b"mdat", body)
    (row,) = media.probe_media(spark.createDataFrame([("a", 70, bytearray(data))], "id string, n_bytes long, media binary")).collect()
    assert row.id == "a" and [(t.codec, t.handler, t.duration, t.n_samples, t.payload_sha256) for t in row.tracks] == [
        ("mp4a", "soun", 20, 2, hashlib.sha256(body[:10]).hexdigest()), ("avc1", "vide", 30, 3, hashlib.sha256(body[10:]).hexdigest())]
    assert [[(k.offset, k.length) for k in t.keyframes] for t in row.tracks] == [[(at, 4), (at + 4, 6)], [(at + 10, 10), (at + 40, 30)]]


EMPTY = [_full(b"stts", struct.pack(">I", 0)), _full(b"stsc", struct.pack(">I", 0)), _full(b"stsz", struct.pack(">II", 0, 0)), _full(b"stco", struct.pack(">I", 0))]


def flagged(kind, flags, form, *numbers):
    return media._box(kind, struct.pack(">I" + form, flags, *numbers))


def test_fragments():
    """Two fragments: sizes of their own and keyframe flags for the first sample; defaults of the movie and of the track fragment; data from the fragment's start, from an offset, after the run before."""
    movie = media._box(b"moov", track(1, b"avc1", EMPTY), track(2, b"mp4a", EMPTY), media._box(b"mvex", _full(b"trex", struct.pack(">IIIII", 1, 1, 5, 0, media.NOT_SYNC)), _full(b"trex", struct.pack(">IIIII", 2, 1, 7, 3, 0))))

    def fragment(start, data_at):
        video = media._box(b"traf", flagged(b"tfhd", media.BASE_IS_MOOF, "I", 1), flagged(b"trun", 0x205, "IiI3I", 3, data_at - start, 0, 8, 9, 10), flagged(b"trun", 0x200, "I1I", 1, 11))
        sound = media._box(b"traf", flagged(b"tfhd", media.BASE_OFFSET | media.SIZE, "IQI", 2, data_at + 38, 4), flagged(b"trun", 0, "I", 2), flagged(b"trun", 0x100, "I2I", 2, 1, 2))
        return media._box(b"moof", _full(b"mfhd", struct.pack(">I", 1)), video, sound)

    data, starts = movie, []
    for k in range(2):
        start = len(data)
        size = len(fragment(start, 0))
        starts.append(start + size + 8)
        data += fragment(start, starts[-1]) + media._box(b"mdat", bytes([k]) * 38 + bytes([100 + k]) * 16)
    video, sound = media.probe(data)
    assert video.sizes.tolist() == [8, 9, 10, 11] * 2 and video.keys.tolist() == [0, 4] and video.duration == 40
    assert video.payload(data) == bytes(38) + bytes([1]) * 38 and video.keyframes() == [(starts[0], 8), (starts[1], 8)]
    assert sound.sizes.tolist() == [4] * 8 and len(sound.keyframes()) == 8 and sound.duration == 2 * (14 + 3)
    assert sound.payload(data) == bytes([100]) * 16 + bytes([101]) * 16
    with pytest.raises(media.MediaError):
        media.probe(data[:-1])
    with pytest.raises(media.MediaError):
        media.probe(media._box(b"moof", media._box(b"traf", flagged(b"tfhd", 0, "I", 9), flagged(b"trun", 0, "I", 1))))


def by_hand(payload):
    """The stored form with every size and field written out from the format's rules, without the operator's code."""
    n = len(payload) // 64
    full, rest = divmod(n, 1024)
    runs = [[1, 1024, 1]] * (full > 0) + [[full + 1, rest, 1]] * (rest > 0)
    keys, chunks = list(range(1, n + 1, 256)), full + (rest > 0)
    stbl = 152 + 4 * len(keys) + 12 * len(runs) + 4 * chunks
    first = 24 + (8 + 120 + 8 + 104 + 8 + 44 + 33 + 8 + 16 + 36 + stbl) + 8
    u = lambda *numbers: b"".join(x.to_bytes(4, "big") for x in numbers)
    long = lambda x: x.to_bytes(8, "big")
    unity = u(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    return b"".join([
        u(24), b"ftypisom", u(512), b"isomiso2", u(first - 32), b"moov", u(120), b"mvhd", u(0x01000000), bytes(16), u(8000), long(64 * n), u(0x10000), b"\x01\x00", bytes(10), unity, bytes(24), u(2),
        u(385 - 128 + stbl), b"trak", u(104), b"tkhd", u(0x01000007), bytes(16), u(1, 0), long(64 * n), bytes(8), b"\0\0\0\0\x01\0\0\0", unity, bytes(8), u(145 + stbl), b"mdia",
        u(44), b"mdhd", u(0x01000000), bytes(16), u(8000), long(64 * n), u(0x55C40000), u(33), b"hdlr", bytes(8), b"soun", bytes(13), u(60 + stbl), b"minf", u(16), b"smhd", bytes(8),
        u(36), b"dinf", u(28), b"dref", u(0, 1, 12), b"url ", u(1), u(stbl), b"stbl", u(52), b"stsd", u(0, 1, 36), b"raw ", bytes(6), b"\0\x01", bytes(8), b"\0\x01\0\x08\0\0\0\0", u(8000 << 16),
        u(24), b"stts", u(0, 1, n, 64), u(16 + 4 * len(keys)), b"stss", u(0, len(keys), *keys), u(16 + 12 * len(runs)), b"stsc", u(0, len(runs)), *[u(*r) for r in runs], u(20), b"stsz", u(0, 64, n),
        u(16 + 4 * chunks), b"stco", u(0, chunks, *[first + 65536 * k for k in range(chunks)]), u(8 + len(payload)), b"mdat", payload,
    ])


@pytest.mark.parametrize("samples", [1, 2, 256, 257, 1023, 1024, 1025, 5000])
def test_stored_form_by_hand(samples):
    payload = bytes(range(256)) * (samples // 4) + bytes(64 * (samples % 4))
    assert media.mux(payload) == by_hand(payload)


def test_boxes_of_any_depth():
    """Boxes are walked without recursion: ten thousand levels are no error."""
    data = b""
    for _ in range(10_000):
        data = struct.pack(">I4s", 8 + len(data), b"moov") + data
    assert [d for d, *_ in media.boxes(data)] == list(range(10_000))
    with pytest.raises(media.MediaError, match="size"):
        list(media.boxes(data[:-4]))


def test_query_against_brute_force(spark, sf_dir):
    """Every column of every document: the stored form is made by hand, box by box."""
    found = {r.doc_id: r for r in op1_media_columns(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs) == 200
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        n = len(payload) // 64
        r = found[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = by_hand(payload)
        at = stored.index(b"mdat") + 4
        assert stored[at:] == payload and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        keys = -(-n // 256)
        last = at + (keys - 1) * 256 * 64 + 64
        assert r.feature == f"raw  8000 Hz, {len(payload) * 1000 // 8000} ms, {n} samples, {keys} keyframes of {64 * keys} bytes from {at} to {last}"
