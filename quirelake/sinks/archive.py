"""Book archives: one deterministic zip for each book, as a value, or streamed through a task and read back."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.errors import ArchiveError
from quirelake.sinks.books import EntryCheck, StoredArchive


def build_archive(files: Iterable[tuple[str, bytes]]) -> bytes:
    """A zip of (name, content) in order, everything stored."""
    out = io.BytesIO()
    z = StoredArchive(out)
    for name, content in files:
        z.add(name, content)
    z.close()
    return out.getvalue()


def entries(data: bytes | BinaryIO) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a zip's entries in order; of a stream one is read at a time."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as z:
        for name in z.namelist():
            yield name, z.read(name)


def check_archive(data: bytes) -> None:
    """Raises ArchiveError unless the required entries are there, the type is right and every XML entry is well formed."""
    check = EntryCheck()
    for name, content in entries(data):
        check.see(name, content)
    if (error := check.result()) is not None:
        raise ArchiveError(error)


def archives(files: DataFrame) -> DataFrame:
    """``book_id, archive, names, error`` from (book_id, place, name, content); an invalid archive is kept with its error.

    ``content`` is text or bytes. A book must fit a worker, as its archive is one value.
    """
    kind = files.schema["book_id"].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("place", kind="stable")
        data = build_archive(zip(rows["name"], (bytes(c) for c in rows["content"])))
        try:
            check_archive(data)
            error = None
        except ArchiveError as e:
            error = str(e)
        return pd.DataFrame({"book_id": group["book_id"].iloc[:1].to_list(), "archive": [data], "names": [rows["name"].to_list()], "error": [error]})

    typed = files.select("book_id", "place", "name", F.col("content").cast("binary").alias("content"))
    return typed.groupBy("book_id").applyInPandas(one, f"book_id {kind}, archive binary, names array<string>, error string")


def archive_digests(files: DataFrame) -> DataFrame:
    """``book_id, bytes, sha256, entries, error`` of each book's archive from (book_id, place, name, content); sha256 is that of every entry's name and content in order, each ended by a line feed.

    A task writes a book's archive entry by entry to a file of its own, reads it back entry by
    entry and drops it, so that neither a value nor a task holds a book.
    """
    kind = files.schema["book_id"].dataType.simpleString()
    schema = f"book_id {kind}, bytes long, sha256 string, entries long, error string"

    def read_back(stream: BinaryIO) -> tuple[int, str, int, str | None]:
        digest, check, n = sha256(), EntryCheck(), 0
        size = stream.seek(0, io.SEEK_END)
        for name, content in entries(stream):
            check.see(name, content)
            for part in (name.encode(), b"\n", content, b"\n"):
                digest.update(part)
            n += 1
        return size, digest.hexdigest(), n, check.result()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = stream = archive = ids = None

        def finish() -> pa.RecordBatch:
            archive.close()
            stream.flush()
            columns = zip(read_back(stream), (pa.int64(), pa.string(), pa.int64(), pa.string()))
            stream.close()
            return pa.RecordBatch.from_arrays([ids, *[pa.array([v], t) for v, t in columns]], names=["book_id", "bytes", "sha256", "entries", "error"])

        for batch in batches:
            books = batch.column("book_id")
            for k in range(batch.num_rows):
                if stream is None or books[k].as_py() != now:
                    if stream is not None:
                        yield finish()
                    now, ids, stream = books[k].as_py(), books.slice(k, 1), tempfile.TemporaryFile()
                    archive = StoredArchive(stream)
                archive.add(batch.column("name")[k].as_py(), batch.column("content")[k].as_py())
        if stream is not None:
            yield finish()

    typed = files.select("book_id", F.col("place").cast("long").alias("place"), "name", F.col("content").cast("binary").alias("content"))
    return typed.repartition("book_id").sortWithinPartitions("book_id", "place").mapInArrow(step, schema)
