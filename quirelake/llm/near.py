"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by SimHash and multi-index hashing.

Texts that are 0.8 alike have SimHash fingerprints that differ in about 15 % of their
bits, too many for small balls round the segments of 64 bits. So the fingerprint is wide:
as many segments as make it all but certain (``MISS``) that two such texts agree, in some
segment, up to one bit. Each fingerprint is a table row under the value of every segment,
and is looked up under all values within one bit of it; whole distances are verified, and
what is left is verified on the whole sets of shingles. Only that decides.

How it is distributed: equal sets are one node from the start, so copies cost nothing. A
range of the values of one segment is a task: it gets each fingerprint once (and once more
for every lookup that leads there from another range) and enumerates the balls itself, so
no row is sent for each lookup. The segments' width and the number of ranges follow the
number of texts, so that neither a range nor the chance hits of a lookup grow with it; the
lookups of a range are dealt over ``SALTS`` tasks. Within a task pairs are compared block
by block, and of those within the distance only ``FORESTS`` minimum spanning forests leave
it, closest pairs first: a group sends a few rows a member, never its pairs, and any two of
its members stay connected by pairs at least as close as they are. Where the sets refuse such
pairs, so that a group falls apart, its members are compared again, and now every pair
between its parts is verified. So only MISS, the agreement in no segment, and SPREADS may
lose a link. Of these pairs a task sends those of members that meet ``FEW`` others; members
that meet more are named only, and their whole sets are sent to the blocks of their group,
where each pair is compared in place and what leaves is a forest of the links. So the rows
sent follow the members, not their pairs; what stays a square is the comparisons in a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import durable, keeps, python_batches, runs, sent, valid_utf8, values, working
from quirelake.llm.components import connected_components
from quirelake.llm.simhash import LOWER_ASCII, SEED, WORD, _grouped, blocks

#: Texts link at a similarity of NUMERATOR / DENOMINATOR or more.
NUMERATOR, DENOMINATOR = 4, 5
#: Share of bits in which such texts differ: the angle between their sets, over a half turn; for sets of four and five, the smallest that aren't equal, it is 0.158.
DIFFER = 0.152
#: Chance that two such texts agree in no segment, and spreads by which a whole distance may exceed its mean.
MISS, SPREADS = 0.006, 5
#: Fingerprints of a range, about; tasks for the lookups of a range; spanning forests that leave a task.
RANGE, SALTS, FORESTS = 1 << 19, 2, 2
#: Others that a member of a torn group may meet in a range for its pairs to be sent; members and hashes of a block of those that meet more.
FEW, MEMBERS, HASHES = 2, 1024, 1 << 19
#: Words whose hashes a worker keeps.
KEPT_WORDS = 100_000
#: Pairs compared at once in a task, and links kept before they are thinned to forests.
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """word -> XXH64, bounded: emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)
        return h


_HASH_OF = _WordHashes()
keeps("near", _HASH_OF.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; texts of fewer words are one shingle, those of none give none."""
    words = WORD.findall((text or "").translate(LOWER_ASCII))
    w = np.fromiter(map(_HASH_OF.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    width = min(width, len(w))
    h = _mixed(w[: len(w) - width + 1])
    for k in range(1, width):
        h = _mixed(h * _ODD + w[k : len(w) - width + 1 + k])
    return np.unique(h)


def node_of(hashes: np.ndarray) -> int:
    """The number that stands for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> bytes:
    """Bits of 64 * ``lanes``, each set where the votes of all hashes sum to more than 0.

    A hash has an odd vote from -255 to 255 on each bit, not only a sign. So the votes of a
    few hashes seldom tie, and small sets differ in as many bits as the angle between them
    says, as large ones do; by signs alone sets of four and five differ in a quarter more.
    """
    odd = _ODD * (np.arange(8 * lanes, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    votes = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 512):  # long texts in pieces: 64 bytes a lane and hash
        votes += np.add.reduce(_mixed(np.multiply.outer(hashes[at : at + 512], odd)).view(np.int8), axis=0, dtype=np.int32)
    return np.packbits(2 * votes + len(hashes) > 0).tobytes()


def index_shape(n: int) -> tuple[int, int, int]:
    """Bits of a segment, number of segments and bits of a value that choose its range, for ``n`` fingerprints."""
    width = min(32, max(16, n.bit_length() - 4))
    alone = (1 - DIFFER) ** width + width * DIFFER * (1 - DIFFER) ** (width - 1)
    return width, ceil(log(MISS) / log(1 - alone)), max(0, ceil(n / RANGE) - 1).bit_length()


def lanes_of(shape: tuple[int, int, int]) -> int:
    return -(-shape[0] * shape[1] // 64)


def distance_limit(bits: int) -> int:
    return int(DIFFER * bits + SPREADS * sqrt(bits * DIFFER * (1 - DIFFER)))


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary array."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), pa.py_buffer(rows)])


def _prints(text: Column, width: int, lanes: int) -> Column:
    """Node, size and fingerprint of a text."""

    @F.arrow_udf("struct<node:long,size:int,fp:binary>")
    def of(texts: pa.Array) -> pa.Array:
        working("near")
        rows = [(node_of(h), len(h), wide_fingerprint(h, lanes)) for h in (shingle_hashes(x, width) for x in values(texts))]
        nodes, sizes, prints = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary())], names=["node", "size", "fp"])

    return of(valid_utf8(text))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """``node, set`` (sorted hashes as bytes) of a column of texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                sets = [shingle_hashes(x, width) for x in batch.column(0).slice(low, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "set"])

    return texts.select(valid_utf8(F.col("text"))).mapInArrow(step, "node long, set binary")


def _alike(left: Column, right: Column) -> Column:
    """Whether two sets are alike, counted on the whole of both."""

    def one(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)

    @F.arrow_udf("boolean")
    def of(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        return pa.array([one(a, b) for a, b in zip(values(lefts), values(rights))], pa.bool_())

    return of(left, right)


def _segment(fp: np.ndarray, k: int, width: int) -> np.ndarray:
    """Values of segment ``k`` of fingerprints given as rows of bytes."""
    low, high = k * width // 8, -(-(k + 1) * width // 8)
    value = np.zeros(len(fp), np.int64)
    for byte in fp[:, low:high].T:
        value = value << 8 | byte
    return value >> (high * 8 - (k + 1) * width) & ((1 << width) - 1)


#: What a row of a range is there for: the table alone, the table and its own lookups, a lookup from another range.
TABLE, OWN, GUEST = 0, 1, 2


def _dealt(width: int, segments: int, top: int):
    """Rows ``range, part, node, fp`` of fingerprints ``node, fp``, with further columns as they are; a range joins segment, top bits of its value and salt."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                fp = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                node = rows.column(0).to_numpy()
                salt = (node.view(np.uint64) % np.uint64(SALTS)).astype(np.int64)
                for k in range(segments):
                    head = (k << top) | (_segment(fp, k, width) >> (width - top))
                    places = [(head * SALTS + s, np.where(salt == s, OWN, TABLE)) for s in range(SALTS)]
                    places += [((head ^ (1 << b)) * SALTS + salt, np.full(len(node), GUEST)) for b in range(top)]
                    for place, part in places:
                        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(part.astype(np.int8)), rows.column(0), _fixed(fp), *rows.columns[2:]], names=["range", "part", "node", "fp", *rows.schema.names[2:]])

    return step


def spanning(links: np.ndarray, forests: int = FORESTS) -> np.ndarray:
    """Of links (distance, a, b) those of some minimum spanning forests, each of what the ones before have left; closer pairs first, then smaller numbers."""
    links = links[np.lexsort((links[:, 2], links[:, 1], links[:, 0]))]
    links = links[np.concatenate([[True], (links[1:] != links[:-1]).any(axis=1)])] if len(links) else links
    nodes, ends = np.unique(links[:, 1:], return_inverse=True)
    ends = ends.reshape(-1, 2)
    taken = np.zeros(len(links), bool)
    for _ in range(forests):
        rank = np.flatnonzero(~taken)
        root = np.arange(len(nodes))
        while True:  # each part takes the first link that leaves it
            x, y = root[ends[rank, 0]], root[ends[rank, 1]]
            rank, x, y = rank[x != y], x[x != y], y[x != y]
            if not len(rank):
                break
            first = np.full(len(nodes), len(links))
            np.minimum.at(first, x, rank)
            np.minimum.at(first, y, rank)
            chosen = np.unique(first[first < len(links)])
            taken[chosen] = True
            root = _merged(root, root[ends[chosen, 0]], root[ends[chosen, 1]])
    return links[taken]


def _merged(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` after the parts x[i] and y[i] became one: the smallest number of each stands for it."""
    part = np.arange(len(root))
    while True:
        low = np.minimum(part[x], part[y])
        new = part.copy()
        for ends in (x, y, part[x], part[y]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, part):
            return part[root]
        part = new


def _close_pairs(width: int, top: int, bits: int, apart: bool = False):
    """Links ``a, b, distance`` that span the pairs of close fingerprints, from rows of :func:`_dealt` in the order of their range.

    ``apart``: of the pairs whose ends differ in ``group`` all that have an end with ``FEW``
    or less of them; both ends of every other one as loops.
    """
    low_bits, limit, lane_limit = width - top, distance_limit(bits), distance_limit(64)

    def of_range(place: int, rows: pa.Table) -> Iterator[np.ndarray]:
        part, node = rows["part"].to_numpy(), rows["node"].to_numpy()
        fp = np.frombuffer(b"".join(b"".join(c.to_pylist()) for c in rows["fp"].chunks), np.uint8).reshape(len(node), -1)
        value = _segment(fp, place // SALTS >> top, width) & ((1 << low_bits) - 1)
        lanes = np.ascontiguousarray(fp).view(np.uint64)
        table = np.flatnonzero(part != GUEST)
        table = table[np.argsort(value[table], kind="stable")]
        known = value[table]
        group = rows["group"].to_numpy() if apart else None
        met = np.zeros(len(node), np.int64)
        for kind, flips in ((OWN, [0, *(1 << b for b in range(low_bits))]), (GUEST, [0])):
            asking = np.flatnonzero(part == kind)
            for flip in flips:
                wanted = value[asking] ^ flip
                first = np.searchsorted(known, wanted, "left")
                for p, t in blocks(first, np.searchsorted(known, wanted, "right") - first, BLOCK):
                    p, t = asking[p], table[t]
                    near = node[p] < node[t]
                    if apart:
                        near &= group[p] != group[t]
                    p, t = p[near], t[near]
                    near = np.bitwise_count(lanes[p, 0] ^ lanes[t, 0]) <= lane_limit
                    p, t = p[near], t[near]
                    far = np.bitwise_count(lanes[p] ^ lanes[t]).sum(axis=1, dtype=np.int64)
                    near = far <= limit
                    p, t, far = p[near], t[near], far[near]
                    if apart:
                        met += np.bincount(np.concatenate([p, t]), minlength=len(node))
                        few = np.minimum(met[p], met[t]) <= FEW
                        many = np.unique(node[np.concatenate([p[~few], t[~few]])])
                        yield np.stack([np.zeros(len(many), np.int64), many, many], 1)
                        p, t, far = p[few], t[few], far[few]
                    yield np.stack([far, node[p], node[t]], 1)

    def batch(links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(links[:, 1]), pa.array(links[:, 2]), pa.array(links[:, 0])], names=["a", "b", "distance"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        held, rows = [], 0
        for place, table in runs(batches):
            for found in of_range(place, table):
                held.append(found)
                rows += len(found)
                if rows > BLOCK:
                    if apart:
                        yield batch(np.unique(np.concatenate(held), axis=0))
                        held = []
                    else:
                        held = [spanning(np.concatenate(held))]
                    rows = 0
        if held and len(kept := np.unique(np.concatenate(held), axis=0) if apart else spanning(np.concatenate(held))):
            yield batch(kept)

    return step


def candidates(prints: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Pairs ``a, b`` of nodes that may be alike, from distinct ``node, fp``: those of spanning forests, or with a column ``group`` all whose ends differ in it, save that nodes with many of them are loops."""
    width, segments, top = shape
    apart = "group" in prints.columns
    rows = prints.mapInArrow(_dealt(width, segments, top), "range long, part byte, node long, fp binary" + ", group long" * apart)
    spans = rows.repartition("range").sortWithinPartitions("range").mapInArrow(_close_pairs(width, top, 64 * lanes_of(shape), apart), "a long, b long, distance long")
    return spans.select("a", "b").distinct()


def torn_groups(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``node, whole, group`` of the groups that ``pairs`` connect but ``links``, those of them that hold, don't; a group is what links connect. Where every two members have been a pair nothing is left to ask."""
    whole = durable(connected_components(pairs, "a", "b").select("node", F.col("component").alias("whole")))
    held = connected_components(links, "a", "b").withColumnRenamed("component", "group")
    members = durable(whole.join(held, "node", "left").select("node", "whole", F.coalesce("group", "node").alias("group")))
    sizes = members.groupBy("whole").agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
    asked = pairs.join(whole, pairs["a"] == whole["node"]).groupBy("whole").agg(F.count("*").alias("asked"))
    torn = durable(sizes.join(asked, "whole").where("low < high AND 2 * asked < n * (n - 1)").select("whole"))
    return members.join(sent(torn), "whole", "left_semi").select("node", "whole", "group")


def _block_links(bits: int):
    """Links ``a, b`` between alike sets of different groups, as many as join the groups, from rows ``pair, side, node, group, fp, set`` in the order of their pair of blocks."""
    limit, lane_limit = distance_limit(bits), distance_limit(64)

    def of_blocks(rows: pa.Table) -> Iterator[tuple[int, int]]:
        side, node, group = (rows[c].to_numpy() for c in ("side", "node", "group"))
        fp, sets = (np.frombuffer(b"".join(b"".join(c.to_pylist()) for c in rows[k].chunks), np.uint64) for k in ("fp", "set"))
        lanes, n = fp.reshape(len(node), -1), pc.binary_length(rows["set"]).to_numpy().astype(np.int64) // 8
        first, known, code = np.cumsum(n) - n, *np.unique(sets, return_inverse=True)
        root = np.unique(group, return_inverse=True)[1]
        right = np.flatnonzero(side >= 0)
        has = np.zeros(len(known), bool)
        for p in np.flatnonzero(side <= 0):
            t = right[(root[right] != root[p]) & ((side[right] > 0) | (node[right] > node[p]))]
            t = t[DENOMINATOR * np.minimum(n[t], n[p]) >= NUMERATOR * np.maximum(n[t], n[p])]
            t = t[np.bitwise_count(lanes[t, 0] ^ lanes[p, 0]) <= lane_limit]
            t = t[np.bitwise_count(lanes[t] ^ lanes[p]).sum(axis=1, dtype=np.int64) <= limit]
            own = code[first[p] : first[p] + n[p]]
            has[own] = True
            both = np.zeros(len(t), np.int64)
            for i, k in blocks(first[t], n[t], BLOCK):
                both += np.bincount(i[has[code[k]]], minlength=len(t))
            has[own] = False
            t = t[DENOMINATOR * both >= NUMERATOR * (n[t] + n[p] - both)]
            joined, one = np.unique(root[t], return_index=True)
            yield from ((int(node[p]), int(node[x])) for x in t[one])
            root[np.isin(root, joined)] = root[p]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near")
        for _, rows in runs(batches):
            if found := list(of_blocks(rows)):
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return step


def dense_links(members: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` that join the groups of ``node, whole, group, fp, set`` as all their alike pairs within a whole do; pairs are compared where two blocks of a whole meet."""
    hashes = F.sum(F.octet_length("set") / 8)
    sizes = durable(members.groupBy("whole").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(hashes / HASHES)).alias("blocks")))
    placed = members.join(sent(sizes), "whole").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.xxhash64("whole", F.least("block", "other"), F.greatest("block", "other")).alias("pair")
    rows = dealt.select(pair, F.signum(F.col("block") - F.col("other")).cast("byte").alias("side"), "node", "group", "fp", "set")
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_block_links(bits), "a long, b long")


def text_key(text: Column) -> Column:
    """A hash of the text's bytes, 0 for null."""
    return F.coalesce(F.xxhash64(text.cast("binary")), F.lit(0).cast("long"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``id, text_key, node, part, component_id`` for every row of ``docs``; component_id is the smallest id reachable by links of similarity 0.8 or more.

    ``text_key`` is a hash of the text's bytes, ``node`` stands for its set of shingles and
    ``part`` for the group.

    Null and wordless texts have the empty set and link with each other only. Repeated rows
    stay repeated, and so do rows that repeat an id with another text. A null id keeps its
    row and never names a component that has another id. Invalid UTF-8 counts as its
    replacement characters. Other columns are ignored whatever their names. An empty table
    gives an empty result.
    """
    python_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = index_shape(docs.count())
    prints = docs.select("id", text_key(F.col("text")).alias("text_key"), _prints(F.col("text"), width, lanes_of(shape)).alias("p")).select("id", "text_key", "p.*")

    def sets_of(prints: DataFrame, near: DataFrame) -> DataFrame:
        ids = durable(prints.join(near, "node", "left_semi").select(F.col("id").alias("near_id")).distinct())
        ids = sent(ids)
        # An id may stand on texts of several nodes, so nodes are taken from the texts again.
        texts = docs.join(ids, docs["id"].eqNullSafe(ids["near_id"]), "left_semi")
        return durable(_sets(texts, width).join(near, "node", "left_semi").dropDuplicates(["node"]))

    def verified(prints: DataFrame, pairs: DataFrame) -> DataFrame:
        sets = sets_of(prints, durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        left, right = (sets.select(F.col("node").alias(k), F.col("set").alias(f"{k}_set")) for k in ("a", "b"))
        return pairs.join(left, "a").join(right, "b").where(_alike(F.col("a_set"), F.col("b_set"))).select("a", "b")

    def links(prints: DataFrame) -> DataFrame:
        nodes = prints.where("size > 0").select("node", "fp").dropDuplicates(["node"])
        pairs = durable(candidates(nodes, shape))
        found = durable(verified(prints, pairs))
        torn = durable(torn_groups(pairs, found))
        if torn.isEmpty():
            return found
        torn = durable(nodes.join(sent(torn), "node"))
        again = durable(candidates(torn.select("node", "fp", "group"), shape).join(pairs, ["a", "b"], "left_anti"))
        dense = durable(again.where("a = b").select(F.col("a").alias("node")))
        if dense.isEmpty():
            return found.unionByName(verified(prints, again))
        # Pairs of two named members meet in the blocks.
        named = sent(dense)
        flags = [named.select(F.col("node").alias(k), F.lit(True).alias(f"{k}_named")) for k in ("a", "b")]
        rest = durable(again.where("a < b").join(flags[0], "a", "left").join(flags[1], "b", "left").where("a_named IS NULL OR b_named IS NULL").select("a", "b"))
        found = found.unionByName(verified(prints, rest))
        members = torn.join(sets_of(prints, dense), "node")
        return found.unionByName(dense_links(members, 64 * lanes_of(shape)))

    return _grouped(prints, links).select("id", "text_key", "node", "part", "component_id")
