"""Running sums over long groups in two steps: within ranges of the order, and over the ranges' totals.

A window over a whole group is one task's work. Here a task has one range of a group, and
what a single task sees of the group is one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order, such as page numbers, in a range.
SPAN = 256


def span_of(order: Column, span: int | None = None) -> Column:
    return F.floor(order / F.lit(span or SPAN)).cast("long")


def running(rows: DataFrame, by: str, order: str, value: Column, name: str, total: str | None = None, span: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``by`` with a smaller ``order``, 0 for the first; with ``total``, a column of that name has the sum over all of them.

    ``order`` is a number that is unique within ``by``; neither is null.
    """
    ranged = rows.withColumn("_running_span", span_of(F.col(order), span)).withColumn("_running_value", value.cast("long"))
    within = Window.partitionBy(by, "_running_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(by).orderBy("_running_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(by, "_running_span").agg(F.sum("_running_value").alias("_running_sum"))
    sums = sums.select(by, "_running_span", F.coalesce(F.sum("_running_sum").over(before), F.lit(0)).alias("_running_before"), F.sum("_running_sum").over(Window.partitionBy(by)).alias("_running_total"))
    joined = ranged.withColumn("_running_local", F.coalesce(F.sum("_running_value").over(within), F.lit(0))).join(sums, [by, "_running_span"])
    out = joined.withColumn(name, F.col("_running_before") + F.col("_running_local"))
    return (out.withColumn(total, F.col("_running_total")) if total else out).drop("_running_span", "_running_value", "_running_local", "_running_before", "_running_total")
