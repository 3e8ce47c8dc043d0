"""Lines that many documents share: dropped everywhere but in the document of the largest id.

Texts are exploded into lines; a line's key is the line stripped and in lower case, and only
its 128-bit hash, the document and the line's position leave the task that reads the text.
Documents are counted for each hash in two steps. Hashes on few rows go by a count that is
combined before the shuffle; for the few that are left the distinct documents are counted,
by hash and document first, so that a line which a third of all documents hold is no single
task's work. The positions to drop are gathered by document, and texts are put together again
from the runs of lines between them, in their order. Two keys are taken for one if their
128-bit hashes agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import SENT, durable, python_batches, sent, valid_utf8, values, working

#: Code points of a key, and documents that hold it, from which its lines go.
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
#: Positions of dropped lines that are sent to every task, at most, rather than shuffled with the texts.
SENT_POSITIONS = 2_000_000
LINE = "array<struct<position:int,again:boolean,a:long,b:long>>"
_BODY = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    """The line stripped of spaces and the controls 9 to 13 at both ends, A-Z in lower case."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def long_lines(text: bytes | None, least: int = LEAST_LENGTH) -> list[tuple[int, bytes]]:
    """(position from 0, 128-bit hash of the key) of the lines whose keys have that many code points."""
    out = []
    for k, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= least and (len(key := line_key(line)) - (0 if key.isascii() else len(key) - len(key.translate(None, _BODY)))) >= least:
            out.append((k, xxhash.xxh3_128_digest(key)))
    return out


def _hashed(text: Column, least: int) -> Column:
    @F.arrow_udf(LINE)
    def of(texts: pa.Array) -> pa.Array:
        working("lines")
        ends, places, again, hashes = [0], [], [], []
        for t in values(texts):
            seen: set[bytes] = set()
            for place, h in long_lines(t, least):
                places.append(place)
                again.append(h in seen)
                hashes.append(h)
                seen.add(h)
            ends.append(len(places))
        halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        rows = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(again, pa.bool_()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["position", "again", "a", "b"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return of(text.cast("binary"))


def _without(lines: Column, positions: Column) -> Column:
    """Lines but those at the positions (sorted, from 0): the runs between them, one after another."""
    ends = F.concat(F.array(F.lit(-1)), positions, F.array(F.size(lines)))
    run = lambda i: F.slice(lines, F.element_at(ends, i + 1) + 2, F.element_at(ends, i + 2) - F.element_at(ends, i + 1) - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(positions)), run))


def shared_lines(lines: DataFrame, least: int) -> DataFrame:
    """``a, b, last``: hashes of the lines (id, again, a, b, ...) that at least ``least`` documents hold, and the largest id of these."""
    often = durable(lines.where("NOT again").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("a", "b"))
    held = lines.where("NOT again").join(sent(often), ["a", "b"])
    documents = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))  # rows without id are one document
    return held.groupBy("a", "b").agg(documents.alias("n"), F.max("id").alias("last")).where(F.col("n") >= least).select("a", "b", "last")


def drop_shared_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_length: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, n_lines, n_dropped`` for every row of ``docs``; ``text`` has the lines that stay, joined by line ends.

    A line goes if its key has ``least_length`` code points and ``least_documents`` documents
    hold it, except from the document of the largest id that holds it. Lines end at LF alone.
    A null or empty text is one empty line, and its text is empty. Rows that repeat an id are
    one document, held together by id and text when texts are put together again; rows
    without id are one document that is smaller than all others. Invalid UTF-8 counts as its
    replacement characters. Other columns are ignored whatever their names. An empty table
    gives an empty result.
    """
    python_batches(docs.sparkSession)
    text = F.coalesce(valid_utf8(F.col(text_col)), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    lines = rows.select("id", "text_key", F.explode(_hashed(F.col("text"), least_length)).alias("line")).select("id", "text_key", "line.*")
    shared = sent(durable(shared_lines(lines, least_documents)))
    gone = lines.join(shared, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("last")))
    drops = durable(gone.groupBy(F.col("id").alias("drop_id"), F.col("text_key").alias("drop_key")).agg(F.array_sort(F.collect_set("position")).alias("positions")))
    size = drops.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("positions")).first()
    drops = F.broadcast(drops) if size.n <= SENT and size.positions <= SENT_POSITIONS else drops
    joined = rows.join(drops, (F.col("text_key") == F.col("drop_key")) & F.col("id").eqNullSafe(F.col("drop_id")), "left").withColumn("lines", F.split("text", "\n"))
    left = F.when(F.col("positions").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("lines"), F.col("positions")), "\n"))
    return joined.select("id", left.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("positions").isNull(), 0).otherwise(F.size("positions")).cast("long").alias("n_dropped"))
