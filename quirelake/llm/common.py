"""Helpers shared by the corpus operators: durable cuts of the lineage and table reading."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable, ensure_checkpoint_dir

__all__ = ["durable", "ensure_checkpoint_dir", "fresh", "keeps", "python_batches", "runs", "sent", "table", "valid_utf8", "values", "working"]


#: Bytes of an Arrow batch that goes to Python; the setting below, where it has Spark's own value, is lowered to this.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def python_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in this session, so that long texts don't fill an executor; a value that was chosen stays."""
    with contextlib.suppress(PySparkException):  # a version without the setting
        if spark.conf.get(BATCH_SETTING).rstrip("b") == str(BATCH_DEFAULT):
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


#: Rows of ids or keys that are sent to every task rather than shuffled with the texts.
SENT = 250_000


def sent(keys: DataFrame) -> DataFrame:
    """A durable table of keys, for a join: sent to every task if it is counted to be small enough."""
    return F.broadcast(keys) if keys.count() <= SENT else keys


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as make it none of the columns, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


_CLEARERS: dict[str, Callable[[], None]] = {}
_last = ""


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Says how to drop what an operator keeps in a Python worker from one batch to the next."""
    _CLEARERS[owner] = clear


def working(owner: str) -> None:
    """Called by a task's Python code: on a change of operator drops what the others keep and gives free memory back, as workers are used again by later stages."""
    global _last
    if owner == _last:
        return
    _last = owner
    for name, clear in _CLEARERS.items():
        if name != owner:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def valid_utf8(text: Column) -> Column:
    """A text with each invalid UTF-8 sequence as a replacement character; null stays null."""
    return F.make_valid_utf8(text)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of each run of equal numbers in the first column of batches that are in its order."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if a == b:
                continue
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def values(column: pa.Array, step: int = 256) -> Iterator:
    """The column's values as Python objects, made a few at a time so that a batch of long texts is not held twice."""
    for low in range(0, len(column), step):
        yield from column.slice(low, step).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
