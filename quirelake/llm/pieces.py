"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose merged
piece has the best score (ties: the leftmost) is merged, its new neighbours join the
agenda, and outdated entries go. Short parts keep the agenda as a list in text order,
whose best entry is its minimum; long ones keep it as a heap. Symbols outside the vocabulary fall back to
their UTF-8 bytes. A text is first cut where no piece of the vocabulary could reach
across (before a run of word marks, and round characters that no longer piece holds), so
the parts are encoded alone and the results of short parts are kept in a bounded table.

The cuts are proven once for each vocabulary, over all its pieces (:func:`prove_cuts`): a
merge gives a piece of the vocabulary, none of which reaches across a cut, so the merges on
its two sides touch different symbols and leave each other alone; and the model file says
that the library takes texts as they stand, with a mark before and for each space. Every
Arrow batch is then checked against the sentencepiece library: each part that the batch has
encoded anew, and the first text of each step as a whole. With byte fallback every decoded
text must also be the text itself. A vocabulary without that proof has every text compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import keeps, python_batches, valid_utf8, working

MARK = "▁"
NEVER = float("inf")
#: Parts kept per worker, and the longest part kept, in characters.
KEPT, LONGEST = 700_000, 40
#: Parts up to this many characters keep their agenda as a list.
SHORT = 32
#: Characters encoded between two checks against the library.
STEP = 1 << 19


class PieceMismatch(ValueError):
    """The agenda and the library disagree, so the vocabulary isn't of the supported kind."""


class _Parts(dict):
    """part -> its ids, computed on first use; when full, parts not asked for since it was last full go."""

    def __init__(self, encode_part):
        super().__init__()
        self.encode_part = encode_part
        self.fresh: list[tuple[str, tuple[int, ...]]] = []  # not yet checked
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.older.pop(part, None)
        if ids is None:
            ids = self.encode_part(part)
            self.fresh.append((part, ids))
        if len(part) <= LONGEST:
            if len(self) >= KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialized message: numbers as they are, others as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, message[at : at + size]
            at += size


#: Of a model, the numbers of its pieces, its text preparation; of a piece, the number of its type and the types that are matched before any merge; of the preparation, the numbers of its table of replacements and its three switches.
PIECES, PREPARATION, TYPE, USER_DEFINED = 1, 3, 3, 4
REPLACEMENTS, SWITCHES = 2, {3: 1, 4: 0, 5: 1}


def taken_as_it_stands(model: bytes) -> bool:
    """Whether a serialized model prepares texts by a mark in front and one for each space alone, and has no piece that is matched before the merges."""
    prepared, switches = False, {3: 1, 4: 1, 5: 1}  # all three are on where the file says nothing
    for number, value in fields(model):
        if number == PIECES and any(n == TYPE and v == USER_DEFINED for n, v in fields(value)):
            return False
        if number == PREPARATION:
            for n, v in fields(value):
                prepared |= n == REPLACEMENTS and len(v) > 0
                if n in switches:
                    switches[n] = v
    return not prepared and switches == SWITCHES


def prove_cuts(pieces: Iterable[str]) -> str | None:
    """The characters that no longer piece holds, if no piece has a mark after another character; else None.

    All pieces are gone through. Parts are cut before each run of marks and round these
    characters; a piece that reached across such a cut would have one of the two forms.
    """
    longer = [p for p in pieces if len(p) > 1]
    if any(a != MARK == b for p in longer for a, b in zip(p, p[1:])):
        return None
    inner = set(chain.from_iterable(longer))
    return "".join(c for c in map(chr, range(128)) if c not in inner)


class PieceCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.cost = {p: -lib.get_score(i) for i, p in enumerate(pieces) if plain[i] and len(p) > 1}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        self.byte_fallback = lib.is_byte(self.bytes[0])
        #: What an id decodes to; control ids to nothing.
        self.surface = [p.replace(MARK, " ") if plain[i] else "" for i, p in enumerate(pieces)]
        if self.byte_fallback:
            for b, i in enumerate(self.bytes):  # a byte above ASCII waits as a surrogate until its neighbours are known
                self.surface[i] = bytes((b,)).decode("ascii", "surrogateescape")
        solo = prove_cuts(self.cost) if taken_as_it_stands(lib.serialized_model_proto()) else None
        if not solo:
            pattern, self.lead = r".+", None
        else:
            alone = "".join(f"\\x{ord(c):02x}" for c in solo)
            self.lead = solo[0]  # no merge crosses it, so a part can follow it in a text of its own
            pattern = f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        self.cut = re.compile(pattern, re.DOTALL).findall
        self.parts = _Parts(self.encode_part)

    def _merge_long(self, part: str) -> list[str]:
        """Symbols after all merges, the agenda being a heap; merged-away places are empty."""
        cost, n = self.cost.get, len(part)
        symbols: list[str] = list(part)
        agenda = [(c, i, pair) for i in range(n - 1) if (c := cost(pair := part[i : i + 2])) is not None]
        heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, left, merged = heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != merged:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = merged, ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                if (c := cost(pair := merged + symbols[nxt])) is not None:
                    heappush(agenda, (c, left, pair))
            if (prior := before[left]) >= 0 and (c := cost(pair := symbols[prior] + merged)) is not None:
                heappush(agenda, (c, prior, pair))
        return symbols

    def _merge_short(self, part: str) -> list[str]:
        """Symbols after all merges, the agenda being a list of costs in text order."""
        cost, never = self.cost.get, NEVER
        symbols = list(part)
        agenda = [cost(a + b, never) for a, b in zip(part, part[1:])]
        while agenda and (best := min(agenda)) is not never:
            i = agenda.index(best)
            del agenda[i]
            merged = symbols[i] = symbols[i] + symbols.pop(i + 1)
            if i < len(agenda):
                agenda[i] = cost(merged + symbols[i + 1], never)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + merged, never)
        return symbols

    def encode_part(self, part: str) -> tuple[int, ...]:
        whole = self.ids.get(part) if len(part) == 1 else None
        if whole is not None:
            return (whole,)
        symbols = self._merge_short(part) if len(part) <= SHORT else list(filter(None, self._merge_long(part)))
        found = tuple(map(self.ids.get, symbols))
        if None not in found:
            return found
        out: list[int] = []
        for s, i in zip(symbols, found):
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of one text with an end id; the empty text has the end id alone."""
        ids = list(chain.from_iterable(map(self.parts.__getitem__, self.cut(MARK + text.replace(" ", MARK))))) if text else []
        if end:
            ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the first mark is dropped, runs of byte ids are read as UTF-8."""
        text = "".join(map(self.surface.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text.removeprefix(" ")

    def checked(self, texts: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids and decoded texts; raises if the library's differ."""
        ids = [self.encode(t) for t in texts]
        decoded = [self.decode(i) for i in ids]
        fresh, self.parts.fresh = self.parts.fresh, []
        every = 1 if self.lead is None else max(1, len(texts))
        if fresh and self.lead is not None:
            head = self.library.encode(self.lead)
            found = self.library.encode([self.lead + p for p, _ in fresh], num_threads=1)
            if any(f != [*head, *i] for f, (_, i) in zip(found, fresh)):
                raise PieceMismatch("agenda and library give other ids for a part")
        if self.library.encode(texts[::every], add_eos=True, num_threads=1) != ids[::every]:
            raise PieceMismatch("agenda and library give other ids")
        if self.library.decode(ids[::every], num_threads=1) != decoded[::every]:
            raise PieceMismatch("decoder and library give other texts")
        if self.byte_fallback and any(d != t.replace(MARK, " ") for d, t in zip(decoded, texts)):
            raise PieceMismatch("a text doesn't come back from its ids")
        return ids, decoded


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec per worker process and vocabulary."""
    return PieceCodec(path)


keeps("pieces", codec.cache_clear)


def _steps(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, n in enumerate(lengths):
        if chars and chars + n > STEP:
            yield start, i
            start, chars = i, 0
        chars += n
    if lengths:
        yield start, len(lengths)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, decoded string`` for every row; ids end with the end id.

    Null and empty texts give the end id alone and the empty text; texts are taken whole,
    however long, and invalid UTF-8 as its replacement characters. Repeated rows stay. Ids
    keep their type. Other columns are ignored whatever their names. An empty table gives
    an empty result.
    """
    python_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(valid_utf8(F.col(text_col)), F.lit("")).alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("pieces")
        tool = codec(model_path)
        for batch in batches:
            for low, high in _steps(pc.utf8_length(batch.column(1)).to_pylist()):
                ids, decoded = tool.checked(batch.column(1).slice(low, high - low).to_pylist())
                offsets = pa.array([0, *_running(map(len, ids))], pa.int32())
                values = pa.array(np.fromiter(chain.from_iterable(ids), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(offsets, values), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    return kept.mapInArrow(step, f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def _running(lengths) -> Iterator[int]:
    total = 0
    for n in lengths:
        total += n
        yield total
