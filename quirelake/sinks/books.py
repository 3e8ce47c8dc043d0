"""Books as files: a Spark data source that streams each book's entries into one archive, with commit and abort.

``rows.write.format("quirelake_books")`` takes rows (target, place, name, content) that
:func:`write_books` has dealt out by target and sorted by place. A task writes an archive entry
by entry into a staging folder of the write, so no value and no task ever holds a book. Only
the commit, after the last task, moves archives to their names; an abort deletes the staging
folder, and so does the commit with what failed or repeated tasks have left there. A book
that isn't valid is not published: the commit lists it in ``_errors.json``.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quirelake.errors import ArchiveError
from quirelake.operators.render import MIMETYPE, REQUIRED_FILES

FORMAT, ERRORS = "quirelake_books", "_errors.json"
#: Bytes of the rows that go to a worker at once, at most, and the session's setting of them.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
XML_SUFFIXES = (".xhtml", ".opf", ".xml")
#: Marks of the archive format's three records, the date of every entry (the first day that it knows), and the flag of names beyond ASCII.
LOCAL, CENTRAL, END, DATE, UNICODE_NAME = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", 0x21, 0x800
MOST = (1 << 32) - 1


class StoredArchive:
    """Writes entries one after another to a stream that needs no seeking; everything is stored, equal entries give equal bytes."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, content: bytes) -> None:
        raw, flag = name.encode(), 0 if name.isascii() else UNICODE_NAME
        head = struct.pack("<HHHHIIIHH", flag, 0, 0, DATE, zlib.crc32(content), len(content), len(content), len(raw), 0)
        self.entries.append((raw, head, self.at))
        if self.at + len(content) > MOST or len(self.entries) > 0xFFFF:
            raise ArchiveError("a book is beyond what its archive format can hold")
        self._put(LOCAL + struct.pack("<H", 20) + head + raw)
        self._put(content)

    def close(self) -> None:
        first = self.at
        for raw, head, at in self.entries:
            self._put(CENTRAL + struct.pack("<BBH", 20, 3, 20) + head + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw)
        self._put(END + struct.pack("<HHHHIIH", 0, 0, len(self.entries), len(self.entries), self.at - first, first, 0))


class EntryCheck:
    """What makes a valid book, entry by entry: the required ones, the type, and markup that is well formed."""

    def __init__(self) -> None:
        self.names: set[str] = set()
        self.error: str | None = None

    def see(self, name: str, content: bytes) -> None:
        self.names.add(name)
        if name == "mimetype" and content != MIMETYPE.encode():
            self.error = self.error or "wrong mimetype"
        if name.endswith(XML_SUFFIXES):
            try:
                ElementTree.fromstring(content)
            except ElementTree.ParseError as e:
                self.error = self.error or f"{name} is not well formed: {e}"

    def result(self) -> str | None:
        missing = sorted(set(REQUIRED_FILES) - self.names)
        return f"missing: {', '.join(missing)}" if missing else self.error


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path if ":/" in path else posixpath.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    staged: list[tuple[str, str]] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


class BookWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = file_system(self.path)
        folder = f"{root}/{self.run}/{uuid.uuid4().hex}"  # of this attempt alone
        done, now, stream = Written(), None, None

        def finish() -> None:
            archive.close()
            stream.close()
            if (error := check.result()) is not None:
                done.errors[now] = error
                files.delete_file(staged)
            else:
                done.staged.append((staged, f"{root}/{now}"))

        for r in rows:
            if r.target != now:
                if stream is not None:
                    finish()
                now, staged = r.target, f"{folder}/{len(done.staged) + len(done.errors)}"
                files.create_dir(folder)
                stream = files.open_output_stream(staged)
                archive, check = StoredArchive(stream), EntryCheck()
            content = bytes(r.content)
            check.see(r.name, content)
            archive.add(r.name, content)
        if stream is not None:
            finish()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, root = file_system(self.path)
        done = [m for m in messages if m is not None]
        for m in done:
            for staged, final in m.staged:
                files.create_dir(posixpath.dirname(final))
                files.move(staged, final)
        if errors := {k: v for m in done for k, v in m.errors.items()}:
            with files.open_output_stream(f"{root}/{ERRORS}") as out:
                out.write(json.dumps(errors, sort_keys=True).encode())
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, files: pafs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.run}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.run}")


class BookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "target string, place long, name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BookWriter(self.options["path"])


def write_books(files: DataFrame, names: DataFrame, path: str) -> dict[str, str]:
    """Writes ``files`` (book_id, place, name, content) as archives below ``path``, one for each of ``names`` (book_id, target); the errors of those that weren't valid, by target.

    A book with several targets is written for each. ``path`` may be any file system that the
    tasks reach; books that are there already are replaced.
    """
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(BookSource)
    rows = files.join(names, "book_id").select("target", F.col("place").cast("long").alias("place"), "name", F.col("content").cast("binary").alias("content"))
    at, root = file_system(path)
    if at.get_file_info(f"{root}/{ERRORS}").type != pafs.FileType.NotFound:
        at.delete_file(f"{root}/{ERRORS}")
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(BATCH_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))))  # what a worker holds of a book at once
    try:
        rows.repartition("target").sortWithinPartitions("target", "place").write.format(FORMAT).mode("append").option("path", path).save()
    finally:
        spark.conf.set(BATCH_SETTING, before)
    if at.get_file_info(f"{root}/{ERRORS}").type == pafs.FileType.NotFound:
        return {}
    with at.open_input_stream(f"{root}/{ERRORS}") as stream:
        return json.loads(stream.read())
