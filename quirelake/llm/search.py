"""Ranked lexical search of a query set over a corpus: the three-phase uniform threshold algorithm over lists partitioned by term.

A document's score for an item is a sum over the item's terms of a weight, which a term has,
times an impact, which the term's count in the document and the document's length give. The
postings (term, document, count, length) of the query set's terms are written once, dealt out
by term and by a hash of the document, so that the list of a term that every document has is
spread. Then

1. the heads of the lists, ``k`` entries each, give partial scores; the k-th best partial
   score of an item is a lower bound of its k-th best score;
2. an entry that adds less than that bound shared equally among the item's lists can be left
   out of all lists alike: a document that is in none of them otherwise is worse than the
   bound. (One ``SHARE``-th of this is the threshold: what entries left out may add is then
   so little that few documents stay candidates, while hardly more entries are read.) The entries above it are dealt out by document, where partial scores are summed,
   and each gets an upper bound: what its other lists could add at most, which is less than
   the threshold and no more than the list's first entry. Candidates are those whose upper
   bound reaches the k-th best partial score now known;
3. the candidates' entries are looked up in all lists, and exact scores decide.

So nothing is lost, whatever the data; only how much phase 2 reads depends on them. What the
driver and every task hold is the query set alone: its terms, their weights and thresholds.
It is worked off in blocks of items with at most about ``LISTS`` lists, each with a pass over
the corpus, so that this is bounded as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.durable import discard, scratch_path
from quirelake.llm.common import durable, python_batches, sent, valid_utf8, values, working

#: Lists of a block of items, about: pairs of an item and a term of it.
LISTS = 1_000_000
#: Documents by which the list of one term is parted, about.
PART = 1 << 14
#: By how much the threshold is below the equal share of the bound; any number from 1 is right.
SHARE = 8
#: Items times documents whose sums a task holds at once, and entries of items that it adds at once.
CELLS, ENTRIES = 1 << 20, 1 << 20
#: Candidates that a task holds to let later documents rule them out.
HELD = 1 << 19
#: What stands in a term's place in the row of a document itself.
DOCUMENT = -1

#: Bytes to what they count as: letters, digits and all beyond ASCII stand for themselves, A-Z for lower case, anything else parts terms.
_FOLDED = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return (text or b"").translate(_FOLDED).split()


def impact(documents: int, total: int) -> Column:
    """An entry's impact from its columns ``tf`` and ``n`` (the document's length): 64-bit integers, divisions round down."""
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {documents}L) div {total}L))")


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass(frozen=True)
class Block:
    """The lists of a block of items, sorted by term: ``item[i]`` has a list of ``term[i]`` that it repeats ``times[i]`` times."""

    items: list
    numbers: dict[bytes, int]
    term: np.ndarray
    item: np.ndarray
    times: np.ndarray


@dataclass(frozen=True)
class Plan:
    """What phase 2 needs: lists ``start[t]`` to ``start[t + 1]`` of term t, their items, factors of the impact and most that an unseen entry adds; by item its threshold, the sum of those and its lower bound."""

    start: np.ndarray
    item: np.ndarray
    factor: np.ndarray
    unseen: np.ndarray
    threshold: np.ndarray
    most: np.ndarray
    least: np.ndarray
    k: int


def _counted(rows: DataFrame) -> DataFrame:
    """``item, term, times`` of rows (item, text as bytes)."""
    kind = rows.schema["item"].dataType

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t) for t in values(batch.column(1))]
            owner = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array([t for x in found for t in x], pa.binary())], names=["item", "term"])

    return rows.mapInArrow(step, f"item {kind.simpleString()}, term binary").groupBy("item", "term").agg(F.count("*").alias("times"))


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    counted = durable(_counted(items.select(F.col(item_col).alias("item"), valid_utf8(F.col(text_col)).cast("binary").alias("text"))))
    parts = max(1, math.ceil(counted.count() / LISTS))
    for part in range(parts):
        rows = counted.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()  # about LISTS of them
        numbers = {t: n for n, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        names = {i: n for n, i in enumerate(dict.fromkeys(r.item for r in rows))}
        lists = sorted((numbers[bytes(r.term)], names[r.item], r.times) for r in rows)
        if lists:
            term, item, times = (np.array(x, np.int64) for x in zip(*lists))
            yield Block(list(names), numbers, term, item, times)


def _postings(numbers: Broadcast):
    """Rows ``term, row, n, tf, id``: one for each of a document's terms that has a number, one for the document."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("search")
        number = numbers.value.get
        for batch in batches:
            lengths, sizes, terms, counts = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for text in values(batch.column(2)):
                words = terms_of(text)
                known = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                t, c = np.unique(known[known >= 0], return_counts=True)
                lengths.append(len(words))
                sizes.append(len(t))
                terms.append(t.astype(np.int32))
                counts.append(c)
            n, rows = np.array(lengths, np.int64), batch.column(0)
            names = ["term", "row", "n", "tf", "id"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), DOCUMENT, np.int32)), rows, pa.array(n), pa.array(np.zeros(len(n), np.int64)), batch.column(1)], names=names)
            owner = np.repeat(np.arange(len(n)), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(terms)), rows.take(pa.array(owner)), pa.array(n[owner]), pa.array(np.concatenate(counts)), pa.nulls(len(owner), batch.column(1).type)], names=names)

    return step


def _kth(sums: DataFrame, k: int, items: int) -> np.ndarray:
    """The k-th best ``low`` of each item, or 0 where it has fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low"), "row"))
    out = np.zeros(items, np.int64)
    for r in sums.select("item", "row", "low").withColumn("place", place).where(F.col("place") == k).collect():  # a row an item
        out[r.item] = r.low
    return out


def _partials(plan: Broadcast):
    """Rows ``item, row, low, high``: candidates with their partial scores and upper bounds, from entries ``row, term, impact`` in the order of their rows."""

    def summed(p: Plan, best: np.ndarray, rows: np.ndarray, term: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        names, place = np.unique(rows, return_inverse=True)
        items, width = len(p.least), len(names)
        low, seen = np.zeros(items * width, np.int64), np.zeros(items * width, np.int64)
        many = p.start[term + 1] - p.start[term]
        upto = np.cumsum(many)
        cuts = [0, *np.searchsorted(upto, np.arange(ENTRIES, upto[-1], ENTRIES), "left"), len(term)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            each = many[a:b]
            at = np.arange(each.sum()) + np.repeat(p.start[term[a:b]] - np.cumsum(each) + each, each)
            adds = p.factor[at] * np.repeat(value[a:b], each)
            cell = p.item[at] * width + np.repeat(place[a:b], each)
            good = adds >= p.threshold[p.item[at]]
            np.add.at(low, cell[good], adds[good])
            np.add.at(seen, cell[good], p.unseen[at[good]])
        low, seen = low.reshape(items, width), seen.reshape(items, width)
        both = np.concatenate([best, low], axis=1)
        best[:] = np.partition(both, both.shape[1] - p.k, axis=1)[:, -p.k :]
        high = low + p.most[:, None] - seen
        i, r = np.nonzero((low > 0) & (high >= np.maximum(p.least, best.min(axis=1))[:, None]))
        return [i.astype(np.int32), names[r], low[i, r], high[i, r]]

    def reaching(p: Plan, best: np.ndarray, held: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Of the candidates held those that reach what the task knows by now."""
        item, row, low, high = (np.concatenate(x) for x in zip(*held))
        good = high >= np.maximum(p.least, best.min(axis=1))[item]
        return [item[good], row[good], low[good], high[good]]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("search")
        p: Plan = plan.value
        best = np.zeros((len(p.least), p.k), np.int64)  # partial scores known in this task
        width = max(64, CELLS // len(p.least))
        held: list[list[np.ndarray]] = []
        for rows, term, value in _whole_documents(batches):
            cuts = [*np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])[::width], len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                held.append(summed(p, best, rows[a:b], term[a:b], value[a:b]))
            held = [reaching(p, best, held)]  # the first documents were held against less
            if len(held[0][0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["item", "row", "low", "high"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["item", "row", "low", "high"])

    return step


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches in the order of the first one, in pieces that part no equal values."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= ENTRIES // 4:
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero(np.diff(whole[0]))[-1]) + 1 if whole[0][0] != whole[0][-1] else 0
            if cut:
                yield [x[:cut] for x in whole]
            held, n = [[x[cut:] for x in whole]], n - cut
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _table(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """A table of the query set's numbers, which are bounded by its block, for every task."""
    return F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()})))


def _best(postings: DataFrame, block: Block, k: int) -> DataFrame | None:
    """``item`` (its number), ``id``, ``rank``, ``score`` of the k best documents of a block's items; None if there is no term in any document."""
    spark, items = postings.sparkSession, len(block.items)
    texts = postings.where((F.col("term") == DOCUMENT) & (F.col("n") > 0)).agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
    if not texts.n:
        return None
    listed = postings.where(F.col("term") >= 0)
    weight = np.zeros(len(block.numbers), np.int64)
    for r in listed.groupBy("term").count().collect():  # a row a term of the block
        weight[r.term] = term_weight(texts.n, r["count"])
    entries = listed.select("term", "row", impact(texts.n, texts.total).alias("impact"))
    used = np.flatnonzero(weight[block.term])
    term, item, factor = block.term[used], block.item[used], (weight[block.term] * block.times)[used]
    lists = _table(spark, term=term.astype(np.int32), item=item.astype(np.int32), factor=factor)

    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    heads = durable(entries.withColumn("place", place).where(F.col("place") <= k))
    top = np.zeros(len(weight), np.int64)
    for r in heads.where("place = 1").select("term", "impact").collect():  # a row a term of the block
        top[r.term] = r.impact
    added = F.sum(F.col("factor") * F.col("impact"))
    least = _kth(heads.join(lists, "term").groupBy("item", "row").agg(added.alias("low")), k, items)

    threshold = np.maximum(1, -(-least // (SHARE * np.maximum(1, np.bincount(item, minlength=items)))))
    unseen = np.minimum(threshold[item] - 1, factor * top[term])
    most = np.zeros(items, np.int64)
    np.add.at(most, item, unseen)
    start = np.searchsorted(term, np.arange(len(weight) + 1))
    plan = spark.sparkContext.broadcast(Plan(start, item, factor, unseen, threshold, most, least, k))
    need = np.full(len(weight), np.iinfo(np.int64).max)
    np.minimum.at(need, term, -(-threshold[item] // factor))
    known = np.unique(term)
    above = entries.join(_table(spark, term=known.astype(np.int32), need=need[known]), "term").where(F.col("impact") >= F.col("need")).select("row", "term", "impact")
    found = durable(above.repartition("row").sortWithinPartitions("row").mapInArrow(_partials(plan), "item int, row long, low long, high long"))
    least = np.maximum(least, _kth(found, k, items))
    bounds = _table(spark, item=np.arange(items, dtype=np.int32), least=least)
    wanted = sent(durable(found.join(bounds, "item").where(F.col("high") >= F.col("least")).select("item", "row")))

    scores = entries.join(wanted, "row").join(lists, ["item", "term"]).groupBy("item", "row").agg(added.alias("score")).where(F.col("score") > 0)
    rows = postings.where(F.col("term") == DOCUMENT).select("row", "id").join(wanted.select("row").distinct(), "row", "left_semi")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    return scores.join(rows, "row").withColumn("rank", rank).where(F.col("rank") <= k).select("item", "id", "rank", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, id, score``: for each item the k documents of the highest scores above 0, all if fewer; equal scores by id, null last.

    Every row of ``docs`` is a document of its own, equal ones too. A null text has no term;
    an item without a term that the corpus has gives no row. Rows that repeat an item's id
    are one item with the terms of all of them; a null id is an item. Invalid UTF-8 counts as
    its replacement characters. Other columns are ignored whatever their names. Empty tables
    give an empty result. Documents are numbered as they are read, so ``docs`` must come in
    the same order if a part is computed again, as files and durable tables do.
    """
    spark = docs.sparkSession
    python_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), valid_utf8(F.col(text_col)).cast("binary").alias("text"))
    id_kind, item_kind = rows.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    parts = max(1, math.ceil(docs.count() / PART))
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, id {id_kind}, score long")
    for block in _blocks(items, item_col, item_text_col):
        numbers = spark.sparkContext.broadcast(block.numbers)
        read = rows.mapInArrow(_postings(numbers), f"term int, row long, n long, tf long, id {id_kind}")
        path = scratch_path(spark, "postings")
        try:
            read.repartition("term", F.pmod(F.xxhash64("row"), F.lit(parts))).sortWithinPartitions("term").write.parquet(path)
            if (best := _best(spark.read.parquet(path), block, k)) is not None:
                names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {item_kind}")
                out = out.unionByName(durable(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "id", "score")))
        finally:
            discard(spark, path)
    return out
