"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a group-by-minimum and an equi-join, so no group is ever gathered in one
task, and the number of rounds grows with the logarithm of the longest chain. Each round
is cut with ``checkpoint()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import durable


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each left node has one link and no right node is a left node: then links lead to roots."""
    lefts = edges.groupBy("u").agg(F.count("*").alias("n"))
    several = lefts.where("n > 1").limit(1).count()
    if several:
        return False
    return edges.join(lefts.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node that occurs in ``edges``; component is its smallest node.

    Rows with a null end and loops are left out; repeated rows count once. An empty
    table gives an empty result.
    """
    e = durable(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    while not _is_star_forest(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are cut off before the join, whose two sides can then be split where a hub is skewed.
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large)
        lowest = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
