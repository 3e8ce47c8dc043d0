"""Language-model scoring by deleted interpolation.

A token's probability is a mixture of its maximum-likelihood estimates after the previous
token and alone, and of the uniform distribution over the known tokens and one unknown:

    P(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1)

where b is the bucket of the context's frequency c(v) (its power of two; 0: unseen). The
mixture weights of every bucket are learned by expectation-maximisation on counts of
training texts that were held out of the counts which the estimates then use ("deleted");
the final estimates use all training texts.

How it is distributed: texts are cut into chunks of about ``CHUNK`` tokens, and a chunk
keeps its tokens as local numbers with one 64-bit hash for each distinct word. A chunk
sends each distinct word and pair once, as a sorted, delta-coded block of hashes for
every range of the hash space, so a frequent pair costs a row a chunk, not a row an
occurrence. The task of a range adds up the counts and answers each block with the
counts alone, in the block's order; a chunk is then scored with its own answers. Where
there are more than 2**LEVEL_BITS ranges, blocks go through levels that bundle them
(:func:`_resolved`), so that their number stays in proportion to the tokens. No table of
the corpus is broadcast or held whole anywhere. Two words are taken for one if
their 64-bit hashes agree, which has a chance of about n*n / 3.7e19 for n distinct words.
Pairs are told apart by ``PAIR_BITS`` bits more than it takes to number all tokens, up to 64
in all, so a pair shares its count with another one with a chance of 2**-PAIR_BITS up to
2**40 tokens, and of tokens / 2**64 beyond.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import durable, python_batches, valid_utf8, values, working
from quirelake.llm.simhash import LOWER_ASCII, WORD

SEED = 42
#: Tokens of a chunk, about; a text is never cut.
CHUNK = 1 << 21
#: Keys of a range, about, if every token made a key.
RANGE = 1_500_000
PAIR_BITS = 24
#: Classes of texts: counted, held out of the deleted estimates, never learned from.
COUNTED, DELETED, UNSEEN = 0, 1, 2
#: A space can't be in a word, so no word has this hash's source.
END_HASH = xxhash.xxh64_intdigest(b" end", SEED)
ROW = "chunk long, kind int, part long, data binary, more binary"
#: Bins a power of two for the estimates that EM reads.
BINS = 8
EM_ROUNDS = 60
#: Bits of the keys by which askers are parted at once.
LEVEL_BITS = 12


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, byte plane by byte plane."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<4sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    planes = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.compress(head + b"".join(planes), 3)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, out = struct.unpack_from("<I", raw)[0], []
    at = 4 + 12 * n
    for kind, size in (struct.unpack_from("<4sQ", raw, 4 + 12 * i) for i in range(n)):
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += size * dtype.itemsize
    return out


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as differences, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type."""
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of (context hash, word hash) pairs."""
    k = before * np.uint64(0x9E3779B97F4A7C15) + word
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(32))


class _Numbers(dict):
    """word -> local number; 0 is the end."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one class become chunks: local numbers of tokens, lengths and ids of texts, hashes of words.

    A chunk's number ends in its class: number % 4.
    """
    working("ngram")
    task = TaskContext.get().partitionId()
    made = 0

    class Open:
        def __init__(self) -> None:
            self.numbers, self.tokens, self.lengths, self.ids, self.total = _Numbers(), [], [], [], 0

        def add(self, id_: str | None, text: str | None) -> None:
            words = WORD.findall(text.translate(LOWER_ASCII)) if text else []
            mine = np.zeros(len(words) + 1, np.uint32)
            mine[:-1] = np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words))
            self.tokens.append(mine)
            self.lengths.append(len(mine))
            self.ids.append(id_)
            self.total += len(mine)

        def row(self, number: int) -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in self.numbers), np.uint64, len(self.numbers))
            data = _pack(np.concatenate(self.tokens), np.array(self.lengths, np.uint32), np.frombuffer(json.dumps(self.ids).encode(), np.uint8))
            return _rows([(number, -1, self.total, data, _pack(np.concatenate([np.array([END_HASH], np.uint64), hashes])))])

    parts: dict[int, Open] = {}
    for batch in batches:
        for id_, text, kind in zip(batch.column(0).to_pylist(), values(batch.column(1)), batch.column(2).to_pylist()):
            if kind not in parts:
                parts[kind] = Open()
            part = parts[kind]
            part.add(id_, text)
            if part.total >= CHUNK:
                yield parts.pop(kind).row(((task << 24) + made) * 4 + kind)
                made += 1
    for kind, part in sorted(parts.items()):
        yield part.row(((task << 24) + made) * 4 + kind)
        made += 1


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["chunk", "kind", "part", "data", "more"])


class _Chunk:
    """A chunk's tokens and its sorted distinct keys."""

    def __init__(self, data: bytes, more: bytes, pair_bits: int):
        self.tokens, lengths, ids = _unpack(data)
        self.ids = json.loads(ids.tobytes())
        (self.hashes,) = _unpack(more)
        self.starts = np.cumsum(lengths, dtype=np.int64) - lengths
        self.lengths = lengths.astype(np.int64)
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = 0  # a text follows an end
        self.order = np.argsort(self.hashes, kind="stable")
        self.words = self.hashes[self.order]
        self.word_counts = np.bincount(self.tokens, minlength=len(self.hashes))[self.order]
        keys = _pair_keys(self.hashes[self.before], self.hashes[self.tokens]) >> np.uint64(64 - pair_bits) << np.uint64(64 - pair_bits)
        self.pairs, self.pair_at, self.pair_counts = np.unique(keys, return_inverse=True, return_counts=True)

    def by_word(self, answers: np.ndarray) -> np.ndarray:
        """Answers in the order of the sorted words, for each local number."""
        out = np.empty_like(answers)
        out[self.order] = answers
        return out


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of sorted keys by their top ``bits`` of 64."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
        yield int(part[a]), a, b


def _counted(counts: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Counts by learned class."""
    return _pack(*map(_small, counts))


def _ask(bits: int, pair_bits: int):
    """Each chunk's distinct words (kind 0) and pairs (kind 1), a block for each part of the keys by their top bits; ``more`` has their counts in the chunk."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("ngram")
        for batch in batches:
            for chunk, data, more in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                c = _Chunk(data, more, pair_bits)
                rows: list[tuple] = []
                for which, keys, counts in ((0, c.words, c.word_counts), (1, c.pairs, c.pair_counts)):
                    by_class = tuple(counts if chunk % 4 == k else np.zeros_like(counts) for k in (COUNTED, DELETED))
                    for part, a, b in _parts(keys, bits):
                        rows.append((chunk, which, part, _pack_sorted(keys[a:b]), _counted((by_class[0][a:b], by_class[1][a:b]))))
                yield _rows(rows)

    return step


class _Merged:
    """Blocks of several askers as one: their distinct keys with summed counts, and the place of each block's keys among these."""

    def __init__(self, blocks: list[tuple[int, int, bytes, bytes]]):
        keys = [_unpack_sorted(data) for *_, data, _ in blocks]
        self.known, at = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        self.places = [at[end - len(k) : end] for end, k in zip(ends, keys)]
        self.counts = (np.zeros(len(self.known), np.int64), np.zeros(len(self.known), np.int64))
        for place, (*_, more) in zip(self.places, blocks):
            for total, mine in zip(self.counts, _unpack(more)):
                total[place] += mine.astype(np.int64)  # a block has a key once

    def replies(self, blocks: list[tuple[int, int, bytes, bytes]], kind: int, counts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        """Each block's answer, in its own order, from the counts of all keys."""
        return _rows([(asker, kind, part, _counted((counts[0][place], counts[1][place])), b"") for place, (asker, part, *_) in zip(self.places, blocks)])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of part and kind: one answer a block with the counts of its keys, and each part's totals (kinds 10 to 12: counted and deleted tokens, known words) as asker -1."""
    working("ngram")
    for (_, kind), blocks in _by(batches, (2, 1)):
        merged = _Merged(blocks)
        yield merged.replies(blocks, kind, merged.counts)
        if kind == 0:
            totals = (merged.counts[0].sum(), merged.counts[1].sum(), (merged.counts[0] + merged.counts[1] > 0).sum())
            yield _rows([(-1, 10 + i, int(x), b"", b"") for i, x in enumerate(totals)])


def _by(batches: Iterator[pa.RecordBatch], columns: tuple[int, int]) -> Iterator[tuple[tuple[int, int], list[tuple[int, int, bytes, bytes]]]]:
    """((a, b), [(asker, part, data, more)]) of each run of equal values in two columns."""
    held: list[tuple[int, int, bytes, bytes]] = []
    now: tuple[int, int] | None = None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for *key, asker, part, data, more in zip(cols[columns[0]], cols[columns[1]], cols[0], cols[2], cols[3], cols[4]):
            if now is not None and tuple(key) != now:
                yield now, held
                held = []
            now = tuple(key)
            held.append((asker, part, data, more))
    if now is not None:
        yield now, held


def _combine(bits: int):
    """Rows with an ``owner`` in the order of owner and kind: each owner asks for all of them at once, by more bits of the keys."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("ngram")
        for (owner, kind), blocks in _by(batches, (5, 1)):
            merged = _Merged(blocks)
            yield _rows([(owner, kind, part, _pack_sorted(merged.known[a:b]), _counted((merged.counts[0][a:b], merged.counts[1][a:b]))) for part, a, b in _parts(merged.known, bits)])

    return step


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of owner, kind and part: what each owner was told (``more`` is null) and what it was asked become an answer to each asker."""
    working("ngram")
    for (_, kind), rows in _by(batches, (5, 1)):
        told = [_unpack(data) for *_, data, more in rows if more is None]
        blocks = [r for r in rows if r[3] is not None]
        yield _Merged(blocks).replies(blocks, kind, tuple(np.concatenate(c).astype(np.int64) for c in zip(*told)))


def _resolved(asked: DataFrame, top: int, bits: int, askers: int) -> DataFrame:
    """Answers to blocks (ROW, the asker as ``chunk``) of the parts of keys by their ``top`` bits, of which ``bits`` make a range that a task can hold.

    Beyond LEVEL_BITS askers don't ask ranges themselves: those of one part make bundles,
    about as many keys each as a chunk has, and a bundle asks for all of its askers. So every
    level has at most 2**LEVEL_BITS blocks a chunk, and blocks grow with the tokens.
    """
    if top >= bits:
        return durable(asked.repartition("part").sortWithinPartitions("part", "kind", "chunk").mapInArrow(_answer, ROW))
    bundles = max(1, askers >> top)
    asked = durable(asked.withColumn("owner", F.col("part") * bundles + F.pmod(F.xxhash64("chunk"), F.lit(bundles))))
    further = min(bits, top + LEVEL_BITS)
    merged = asked.repartition("owner").sortWithinPartitions("owner", "kind", "chunk").mapInArrow(_combine(further), ROW)
    answers = _resolved(merged, further, bits, askers)
    told = answers.where("chunk >= 0").withColumn("owner", F.col("chunk")).withColumn("more", F.lit(None).cast("binary"))
    replies = asked.unionByName(told).repartition("owner").sortWithinPartitions("owner", "kind", "part").mapInArrow(_reply, ROW)
    return durable(replies.unionByName(answers.where("chunk < 0")))


class _Counts:
    """A chunk with the counts of its words and pairs over the corpus, by learned class."""

    def __init__(self, chunk: _Chunk, words: list[bytes], pairs: list[bytes]):
        self.chunk = chunk
        read = lambda blobs: [np.concatenate(x).astype(np.int64) for x in zip(*map(_unpack, blobs))]
        self.word = [chunk.by_word(x) for x in read(words)]
        self.pair = read(pairs)

    def of(self, classes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(v w), c(v) and c(w) of each token."""
        word, pair = sum(self.word[k] for k in classes), sum(self.pair[k] for k in classes)
        return pair[self.chunk.pair_at], word[self.chunk.before], word[self.chunk.tokens]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _with_answers(pair_bits: int, use):
    """Runs ``use(counts)`` for each chunk; rows come as the chunk (kind -1), then its words' and its pairs' answers by range."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk = None, None
        blobs: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in batches:
            for id_, kind, data, more in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if id_ != now:
                    if chunk is not None:
                        yield use(_Counts(chunk, *blobs))
                    now, chunk, blobs = id_, None, ([], [])
                if kind < 0:
                    chunk = _Chunk(data, more, pair_bits)
                else:
                    blobs[kind].append(data)
        if chunk is not None:
            yield use(_Counts(chunk, *blobs))

    return step


def _cells(total: int, known: int):
    """Held-out tokens of a chunk as counts by bucket and finely binned estimates, with the sums of the estimates."""

    def use(counts: _Counts) -> pa.RecordBatch:
        pair, context, word = counts.of((COUNTED,))
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        p1 = word / max(total, 1)
        low = 64 * BINS
        bins = lambda p: np.where(p > 0, np.clip(low + np.floor(BINS * np.log2(np.maximum(p, 1e-300))).astype(np.int64), 1, low), 0)
        cell = (_bucket(context) * (low + 1) + bins(p2)) * (low + 1) + bins(p1)
        keys, at = np.unique(cell, return_inverse=True)
        sums = [np.bincount(at, w, len(keys)) for w in (None, p2, p1)]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["cell", "n", "p2", "p1"])

    return use


def learn_weights(cell: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, buckets: int = 66) -> np.ndarray:
    """Mixture weights (buckets x 3) by EM from held-out counts ``n`` with estimates; a bucket without counts has those of all buckets together."""
    low = 64 * BINS + 1
    bucket = cell // (low * low)
    p = np.stack([p2, p1, np.full(len(n), p0)], 1)

    def em(p: np.ndarray, n: np.ndarray, prior: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(EM_ROUNDS):
            share = p * w
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            got = (share * n[:, None]).sum(axis=0) + prior
            w = got / got.sum()
        return w

    everywhere = em(p, n, np.full(3, 1e-3), np.full(3, 1 / 3))
    out = np.tile(everywhere, (buckets, 1))
    for b in np.unique(bucket):
        mine = bucket == b
        out[b] = em(p[mine], n[mine], everywhere, everywhere)
    out[0] = [0.0, *(out[0][1:] / out[0][1:].sum())]  # no pair follows an unseen context
    return out


def _scores(weights: np.ndarray, total: int, known: int):
    def use(counts: _Counts) -> pa.RecordBatch:
        pair, context, word = counts.of((COUNTED, DELETED))
        w = weights[_bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] / (known + 1)
        chunk = counts.chunk
        add = lambda x: np.add.reduceat(x, chunk.starts)
        base = add(np.log10((word + 1) / (total + known + 1)))
        return pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.string()), pa.array(chunk.lengths), pa.array(add((word > 0).astype(np.int64))), pa.array(base), pa.array(add(np.log10(p)))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return use


def score_texts(docs: DataFrame, kind: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every row; ``kind`` is COUNTED, DELETED or UNSEEN.

    Learns from the whole texts of the first two classes. ``score`` is the model's log10
    probability of the text with its end, ``base_score`` that of add-one unigrams. Null
    texts count as empty: one token, the end. Repeated rows count and are scored each.
    Without training rows every token is unknown and has probability 1. Texts are taken
    whole, however long, and invalid UTF-8 as its replacement characters. Ids keep their
    type. Other columns are ignored whatever their names. An empty table gives an empty
    result.
    """
    python_batches(docs.sparkSession)
    id_type = docs.select(F.col(id_col)).schema[0].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), valid_utf8(F.col(text_col)).alias("text"), kind.cast("int").alias("kind"))
    chunks = durable(rows.mapInArrow(_chunks, ROW))
    whole = chunks.agg(F.coalesce(F.sum("part"), F.lit(0)).alias("tokens"), F.count("*").alias("chunks")).first()
    tokens = whole["tokens"]
    bits = max(4, int(np.ceil(np.log2(max(1, tokens / RANGE)))))
    pair_bits = min(64, int(np.ceil(np.log2(max(2, tokens)))) + PAIR_BITS)
    top = min(bits, LEVEL_BITS)
    answers = _resolved(chunks.mapInArrow(_ask(top, pair_bits), ROW), top, bits, whole["chunks"])
    totals = {r["kind"]: r["n"] for r in answers.where("chunk = -1").groupBy("kind").agg(F.sum("part").alias("n")).collect()}  # three rows
    counted, deleted, known = (int(totals.get(k, 0)) for k in (10, 11, 12))

    def answered(only: Column) -> DataFrame:
        both = chunks.withColumn("part", F.lit(0).cast("long")).unionByName(answers.where("chunk >= 0")).where(only)
        return both.repartition("chunk").sortWithinPartitions("chunk", "kind", "part")

    held_out = answered(F.col("chunk") % 4 == DELETED).mapInArrow(_with_answers(pair_bits, _cells(counted, known)), "cell long, n long, p2 double, p1 double")
    cells = held_out.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("cell").toArrow()  # bounded by the bins
    n = cells["n"].to_numpy().astype(float)
    weights = learn_weights(cells["cell"].to_numpy(), n, cells["p2"].to_numpy() / np.maximum(n, 1), cells["p1"].to_numpy() / np.maximum(n, 1), 1 / (known + 1))
    if not counted + deleted:
        weights[:] = [0.0, 0.0, 1.0]
    scored = answered(F.lit(True)).mapInArrow(_with_answers(pair_bits, _scores(weights, counted + deleted, known)), "id string, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").cast(id_type).alias("id"), "n_tokens", "n_known", F.lit(counted + deleted).cast("long").alias("train_tokens"), "base_score", "score")
