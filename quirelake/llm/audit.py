"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, by one matrix product.

A document is told by which filters it fails: a mask of one bit a filter. So a part of the
corpus is 32 counts of documents (for five filters), 32 of good and 32 of toxic ones. Each
column of four fixed 0/1 matrices of 32 x 600 stands for an order of the filters and a step
in it, and marks the masks that are kept after the step, removed at it, failing its filter
but removed before, or failing its filter alone. Histograms stacked as rows times these
matrices give every figure of every part.

How it is distributed: masks and a SHA-256 of the text are computed where a document is
read; only these narrow rows are shuffled. The filter for copies needs the smallest id of
each text: the minimum is combined before the shuffle, and a row finds out whether it is
that one by a join on text and id together, so a text that a third of all rows have is
spread over all tasks. A histogram has 32 rows a part, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import durable, python_batches, valid_utf8

WORDS = r"[^\x20\x09-\x0D]+"
#: Parts whose histograms are multiplied at once.
PARTS = 64
OUTPUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 50


def repetitive(text: Column, words: Column) -> Column:
    return F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65


def shouting(text: Column, words: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.char_length(text).cast("long") * 5


def symbols(text: Column, words: Column) -> Column:
    return F.rlike(text, F.lit("[#$%&*|]"))


#: Failure conditions by letter, from a text and its words; the filter for copies has the next letter.
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}
COPIES = "E"


def outcome_matrices(n: int) -> dict[str, np.ndarray]:
    """0/1 matrices of 2**n masks by n! * n columns (an order of the filters and a step, steps of an order side by side); ``own`` has the filter of each column."""
    orders = np.array(list(permutations(range(n))))
    own = orders.ravel()
    bit = 1 << orders
    before = (np.cumsum(bit, axis=1) - bit).ravel()
    mask = np.arange(1 << n)[:, None]
    fails, gone = mask >> own & 1 == 1, mask & before != 0
    as_int = lambda m: m.astype(np.int64)
    return {"own": own, "kept": as_int(~fails & ~gone), "removed": as_int(fails & ~gone), "redundant": as_int(fails & gone), "unique_fails": as_int(mask == 1 << own)}


def failure_masks(docs: DataFrame, conditions: Mapping[str, Callable[[Column, Column], Column]] = CONDITIONS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id, part, mask``: bit k of the mask is set if the text fails condition k; the bit after them, if a smaller id has the same text.

    A null text is empty, a null part is the empty string. A null id is smaller than none
    and has none before it, so its text is never a copy. Rows that repeat an id don't make
    each other copies. Invalid UTF-8 counts as its replacement characters.
    """
    text = F.coalesce(valid_utf8(F.col(text_col)), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = read.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, fails in enumerate(conditions.values())]
    rows = durable(split.select("id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("key")))
    firsts = rows.groupBy("key").agg(F.min("id").alias("first")).select(F.col("key").alias("first_key"), "first")
    marked = rows.join(firsts, (F.col("key") == F.col("first_key")) & (F.col("id") == F.col("first")), "left")
    copy = F.col("first_key").isNull() & F.col("id").isNotNull()
    return marked.select("id", "part", (F.col("mask") + F.when(copy, 1 << len(conditions)).otherwise(0)).alias("mask"))


def histograms(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, cells``: for each part the counts (n, good, toxic) of each mask that it has.

    ``labels`` has quality and toxic, 1 or not; an id with several rows has what any of them
    says. Documents without a label count as neither good nor toxic.
    """
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.groupBy(F.col(id_col).alias("label_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    joined = masks.join(known, F.col("id") == F.col("label_id"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
    counted = joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _multiplied(letters: str):
    """Rows of OUTPUT from histograms: stacked as the rows of a matrix, times the outcome matrices."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = outcome_matrices(len(letters))
        width = len(m["own"])
        names = ["".join(letters[f] for f in order) for order in m["own"].reshape(-1, len(letters))]
        orders, steps = np.repeat(names, len(letters)), np.tile(np.arange(1, len(letters) + 1), len(names))
        fold = (m["own"][:, None] == np.arange(len(letters))).astype(np.int64)  # columns to the filter that they are about
        for batch in batches:
            for low in range(0, batch.num_rows, PARTS):
                rows = batch.slice(low, PARTS)
                stacked = np.zeros((rows.num_rows, 3, 1 << len(letters)), np.int64)
                for k, cells in enumerate(rows.column(1).to_pylist()):
                    for c in cells:
                        stacked[k, :, c["mask"]] = c["n"], c["good"], c["toxic"]
                n, good, toxic = stacked.transpose(1, 0, 2)
                found = {name: n @ m[name] for name in ("kept", "removed", "redundant", "unique_fails")}
                found |= {"good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"], "shapley": (found["removed"] @ fold)[:, m["own"]]}
                parts = rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), width)))
                repeat = lambda a: np.tile(a, rows.num_rows)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([parts, pa.array(repeat(orders)), pa.array(repeat(steps).astype(np.int32)), *(pa.array(v.ravel()) for v in found.values())], names=["part", "filter_order", "step", *found])

    return step


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Callable[[Column, Column], Column]] = CONDITIONS, copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row (OUTPUT) for each part, order of the filters and step in it, zeros included; the figures are those of the filter at that step.

    ``shapley`` is what the filter removes, summed over all orders. See :func:`failure_masks`
    and :func:`histograms` for nulls, copies and labels; other columns are ignored whatever
    their names. An empty table has no parts and gives an empty result.
    """
    python_batches(docs.sparkSession)
    masks = failure_masks(docs, conditions, id_col, text_col, part_col)
    return histograms(masks, labels, id_col).mapInArrow(_multiplied("".join(conditions) + copies), OUTPUT)
