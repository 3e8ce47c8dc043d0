"""Mixing sources to target weights by hash-threshold histograms, with built-in functions only.

Each row has a fixed 48-bit hash of its id. A source's budget beyond whole passes over it
is met by the rows whose hash is below a threshold, found by nested histograms of the
sizes by source and hash (see ``histogram``), without sorting rows. Thresholds are
nested: a larger budget keeps every row that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import durable, fresh
from quirelake.llm.histogram import cut_points

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources up to this many are broadcast (their table is counted first); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def id_hash(id_col: Column) -> Column:
    """First 48 bits of the MD5 of the id's decimal text; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, take the weights in turn. ``share`` of all sizes is
    dealt by weight; a target stops at ``most`` times its source's size and what is over
    is dealt again: with the sources by cap per weight, all above the water line get
    line times weight, all below it their cap.
    """
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    t = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    t = t.withColumn("line", (budget - before) / left).withColumn("k", F.row_number().over(order))
    line = F.min(F.when(F.col("line") <= F.col("ratio"), F.struct("k", "line"))).over(everything)["line"]
    return t.withColumn("level", line).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, source_size, target, passes, below``: whole passes over a source, and the hash below which rows are taken once more."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    planned = durable(targets.withColumn("passes", passes).withColumn("want", F.col("target") - F.col("passes") * F.col("source_size")))
    cuts = cut_points(rows.select(F.col("source").alias("key"), F.col("h").alias("position"), "size"), planned.where("source_size > 0").select(F.col("source").alias("key"), "want"))
    return planned.join(cuts, F.col("source").eqNullSafe(F.col("key")), "left").select("source", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below"))


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``source, source_size, target, passes, below`` for every source of ``docs``; see :func:`thresholds`.

    The size of a row is its number of words, 0 for null. Null is a source of its own and
    comes last. Rows with equal ids have equal hashes and are taken together. A source of
    size 0 gets target 0. An empty table gives an empty result.
    """
    rows = durable(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h")))
    sizes = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    return durable(thresholds(rows, source_targets(sizes, weights, share, most)))


def with_copies(docs: DataFrame, mix: DataFrame, name: str, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with a column ``name``, which no column of ``docs`` may have: struct of copies, source_size and target. Rows are only filtered by hash, never sorted."""
    plan, of = fresh([*docs.columns, name], "plan", "of_source")
    table = mix.select(F.col("source").alias(of), F.struct("source_size", "target", "passes", "below").alias(plan))
    if mix.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    p = F.col(plan)
    copies = p["passes"] + (id_hash(docs[id_col]) < p["below"]).cast("long")
    joined = docs.join(table, docs[source_col].eqNullSafe(F.col(of)))
    return joined.withColumn(name, F.struct(copies.alias("copies"), p["source_size"].alias("source_size"), p["target"].alias("target"))).drop(of, plan)
