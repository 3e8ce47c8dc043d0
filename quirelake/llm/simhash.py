"""SimHash fingerprints and their near-duplicate groups by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of a text's word
shingles. Two fingerprints link at ``radius`` or fewer differing bits. Links are found by
multi-index hashing: the 64 bits are cut into segments, and by the pigeonhole principle
two linked fingerprints agree, in at least one segment, up to that segment's own small
radius. Each distinct fingerprint is stored once under each exact segment value (the
table) and looked up under every value of a small Hamming ball round each of its segments
(the probes); whole distances are then verified.

Skew: equal fingerprints are one row from the start, so copies cost nothing. Probes of a
frequent segment value are dealt over ``SALTS`` tasks, with its table rows repeated in
each. Within a task a run of one value is compared block by block, and of the links found
only a spanning forest leaves the task, so a dense group sends as many rows as it has
members, not as many as it has pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import durable, python_batches, valid_utf8, values, working
from quirelake.llm.components import connected_components

BITS, SEED, SALTS = 64, 42, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER_ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Pairs compared at once in a task.
BLOCK = 1 << 20


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of big-endian 64-bit hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 16384):  # long texts in pieces: 64 bytes a hash
        part = hashes[at : at + 16384].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4) -> int:
    """64 bits, unsigned, of shingles of ``width`` words, repeats included (the whole text, if it has fewer words); null and texts without words give 0."""
    data = " ".join(WORD.findall((text or "").translate(LOWER_ASCII))).encode("utf-8", "surrogatepass")
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(data[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])] if len(ends) >= width else [digest(data, SEED)]
    return _majority(np.array(hashes, dtype=">u8"))


def simhash(text: Column, width: int = 4) -> Column:
    """Fingerprints of a text column as signed longs; invalid UTF-8 counts as its replacement characters."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        working("simhash")
        return pa.array(np.fromiter((fingerprint(x, width) for x in values(texts)), np.uint64, len(texts)).view(np.int64))

    return of(valid_utf8(text))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segment_plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment.

    Distances above every ball radius would add up to more than ``radius``: the first
    ``radius - segments * (radius // segments) + 1`` segments take radius // segments,
    the others one less (none, if that is below zero).
    """
    base, extra = divmod(radius, segments)
    out, at = [], 0
    for k in range(segments):
        width = BITS // segments + (k < BITS % segments)
        ball = base if k <= extra else base - 1
        if ball >= 0:
            out.append((at, width, ball))
        at += width
    return out


def choose_segments(n: int, radius: int) -> int:
    """The number of segments with the least work for ``n`` fingerprints, of those that leave balls to enumerate.

    A probe that is shuffled and sorted costs about as much as 50 comparisons with a stored
    fingerprint; chance candidates are n / 2**width a probe.
    """

    def cost(segments: int) -> float:
        return sum((1 + n / 2**width / 50) * sum(comb(width, i) for i in range(ball + 1)) for _, width, ball in segment_plan(radius, segments))

    return min((k for k in range(2, 9) if any(ball for *_, ball in segment_plan(radius, k))), key=cost)


def _entries(distinct: DataFrame, radius: int, segments: int) -> DataFrame:
    """``run, kind, fp``: table rows (kind 0) and probes (kind 1); run joins segment, its value and salt."""
    table, probes = [], []
    for k, (shift, width, ball) in enumerate(segment_plan(radius, segments)):
        mask = ((1 << width) - 1) << shift
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        table += [(k, shift, signed(mask), 0, s) for s in range(SALTS)]
        flips = [sum(1 << (shift + b) for b in bits) for i in range(ball + 1) for bits in combinations(range(width), i)]
        probes += [(k, shift, signed(mask), signed(f), -1) for f in flips]
    kinds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("k", "shift", "mask", "flip", "salt"), p)]) for p in table + probes])
    rows = distinct.select("fp", F.explode(kinds).alias("p")).select("fp", "p.*")
    value = F.expr("shiftrightunsigned((fp ^ flip) & mask, cast(shift as int))")
    salt = F.when(F.col("salt") >= 0, F.col("salt")).otherwise(F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    # Segments are 32 bits wide at most, so value, segment and salt fit a long.
    run = ((F.col("k") * (1 << 32) + value) * SALTS + salt).alias("run")
    return rows.select(run, (F.col("salt") < 0).cast("byte").alias("kind"), "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the links (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def blocks(first: np.ndarray, n: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, first[i] + k) for each i and each k below n[i], at most about ``most`` pairs at a time."""
    ends = np.cumsum(n)
    at = 0
    while at < len(n):  # as many i as make that many pairs; one with more is cut
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        for low in range(0, int(n[at]) if upto == at + 1 else 1, most):
            m = np.minimum(n[at:upto] - low, most) if upto == at + 1 else n[at:upto]
            offsets = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(np.arange(at, upto), m), np.repeat(first[at:upto] + low, m) + offsets
        at = upto


def _linked(radius: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run0 = fp0 = np.empty(0, np.int64)  # table rows of the last run seen
        found_a: list[np.ndarray] = []
        found_b: list[np.ndarray] = []
        kept = 0

        def flush() -> pa.RecordBatch:
            a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a.clear()
            found_b.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            run, kind, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            run, fp = np.concatenate([run0, run]), np.concatenate([fp0, fp])
            is_table = np.concatenate([np.zeros(len(run0), np.int8), kind]) == 0
            t_run, p_run, t_at, p_at = run[is_table], run[~is_table], np.flatnonzero(is_table), np.flatnonzero(~is_table)
            first, last = np.searchsorted(t_run, p_run, "left"), np.searchsorted(t_run, p_run, "right")
            n = last - first
            p_at, first, n = p_at[n > 0], first[n > 0], n[n > 0]
            for p, t in blocks(first, n):
                t, p = t_at[t], p_at[p]
                near = np.bitwise_count((fp[t] ^ fp[p]).view(np.uint64)) <= radius
                t, p = fp[t[near]], fp[p[near]]
                near = t != p
                if near.any():
                    found_a.append(t[near])
                    found_b.append(p[near])
                    kept += int(near.sum())
                if kept >= BLOCK:
                    yield flush()
                    kept = 0
            if len(run):
                same = t_at[t_run == run[-1]]
                run0, fp0 = run[same], fp[same]
        if found_a:
            yield flush()

    return step


def hamming_links(distinct: DataFrame, radius: int = 4, segments: int | None = None) -> DataFrame:
    """Links ``a, b`` that connect every pair of fingerprints (column ``fp``, distinct longs) within ``radius``.

    Not every close pair has a row of its own, but its two ends are connected by rows.
    """
    segments = segments or choose_segments(distinct.count(), radius)
    rows = _entries(distinct, radius, segments)
    return rows.repartition("run").sortWithinPartitions("run", "kind").mapInArrow(_linked(radius), "a long, b long")


def _grouped(prints: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints`` (id, node and others) with ``part``, the smallest node reachable, and ``component_id``, the smallest id on one; ``links_of`` the prints gives links between nodes."""
    prints = durable(prints)
    firsts = durable(prints.groupBy("node").agg(F.min("id").alias("first")))
    parts = connected_components(links_of(prints), "a", "b")
    linked = durable(firsts.join(parts, "node").select("node", F.col("component").alias("part"), "first"))
    smallest = linked.groupBy("part").agg(F.min("first").alias("smallest"))
    shared = linked.join(smallest, "part").select("node", "part", "smallest")
    named = firsts.join(shared, "node", "left").select("node", F.coalesce("part", "node").alias("part"), F.coalesce("smallest", "first").alias("component_id"))
    return prints.join(named, "node")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, segments: int | None = None) -> DataFrame:
    """``id, fp, component_id`` for every row of ``docs``; component_id is the smallest id reachable by links.

    Null and wordless texts have fingerprint 0 and link like any other. Repeated rows stay
    repeated. A null id keeps its row and never names a component that has another id.
    Ids keep their type. Invalid UTF-8 counts as its replacement characters. Other columns
    are ignored whatever their names. An empty table gives an empty result.
    """
    python_batches(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), width).alias("node"))
    grouped = _grouped(prints, lambda p: hamming_links(p.select(F.col("node").alias("fp")).distinct(), radius, segments))
    return grouped.select("id", F.col("node").alias("fp"), "component_id")
