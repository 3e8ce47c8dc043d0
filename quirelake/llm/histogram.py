"""Cut points in weighted positions by nested histograms, with built-in functions only.

Each row has a key, a position of ``POSITION_BITS`` bits and a size. For a key and a wanted
amount, the cut point is the position below which the sizes come nearest to the amount.
Rows are never sorted: sizes are summed by key and the top ``LEVEL_BITS`` bits, running
sums over at most 2**LEVEL_BITS buckets a key find the bucket in which the amount ends,
and only that bucket's rows are summed by their next bits, until one position is left.
A larger amount never gives a lower cut point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import durable

POSITION_BITS, LEVEL_BITS = 48, 12


def _boundary(rows: DataFrame, wanted: DataFrame, level: int) -> DataFrame:
    """``key, prefix, rest, unit``: the bucket in which a key's amount ends, what of the amount is left for it, and its size."""
    shift = POSITION_BITS - LEVEL_BITS * (level + 1)
    sums = rows.groupBy("key", F.shiftright("position", shift).alias("prefix")).agg(F.sum("size").alias("unit")).where("unit > 0")
    w = Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("before", F.coalesce(F.sum("unit").over(w), F.lit(0)))
    near = at.alias("a").join(wanted.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")))
    return near.where("before <= want and want < before + unit").select("a.key", "prefix", (F.col("want") - F.col("before")).alias("rest"), "unit")


def cut_points(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, below`` from ``rows`` (key, position, size) and ``wanted`` (key, want).

    A key may be null and is then a key like any other. A key whose amount is not below
    the sum of its sizes has no row in the result.
    """
    inside = rows
    for level in range(POSITION_BITS // LEVEL_BITS):
        found = durable(_boundary(inside, wanted, level))
        shift = POSITION_BITS - LEVEL_BITS * (level + 1)
        if shift:
            edge = found.select(F.col("key").alias("edge_key"), "prefix")
            inside = inside.join(edge, F.col("key").eqNullSafe(F.col("edge_key")) & (F.shiftright("position", shift) == F.col("prefix"))).drop("edge_key", "prefix")
            wanted = found.select("key", F.col("rest").alias("want"))
    return found.select("key", (F.col("prefix") + (F.col("rest") * 2 > F.col("unit")).cast("long")).alias("below"))
