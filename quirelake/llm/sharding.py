"""Sharding by k-d tree partitioning, with built-in functions only.

Rows with equal texts form one point whose weight is the sum of their sizes and whose
coordinates are metadata (size, source, language, id). All points start in one node. In
each round every node that is above the target bytes is split in two along the dimension
in which its points spread widest, at the distributed weighted median found by nested
histograms (or beside it, where the node is to hold an odd number of shards); ties along a
dimension are ordered by a hash of the text. A node that has reached the target bytes, or
has one point left, is a shard. The tree is a table of nodes that rounds join by key.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import durable
from quirelake.llm.histogram import POSITION_BITS, cut_points

#: Bits of a position taken by the coordinate; a hash of the text fills the others.
GRID_BITS = 20
#: Node tables of up to this many rows are broadcast; the number is known before each join.
BROADCAST_NODES = 4096
#: Points with more than this share of all rows are hot: there can't be more than its inverse, so they are broadcast.
HOT_SHARE = 1e-5
#: Rows numbered together in one window, and made in one task out of equal rows: about this many.
SLOT_ROWS = 20_000
#: What a node may have above the target bytes and still be a shard.
TOLERANCE = 1.01


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _nodes(df: DataFrame, nodes: int) -> DataFrame:
    return F.broadcast(df) if nodes <= BROADCAST_NODES else df


def kd_shards(points: DataFrame, dims: list[str], shards: int, target_bytes: float) -> DataFrame:
    """``point, weight, shard`` from ``points`` (point, weight and the columns ``dims``, all numeric; null counts as 0).

    Nodes are split until they have the target bytes; ``shards`` are made at most, and
    numbered without gaps.
    """
    ranges = points.agg(*[f(F.coalesce(F.col(d).cast("double"), F.lit(0.0))).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])
    edge = ranges.first()  # one row: the ends of each dimension
    top = (1 << GRID_BITS) - 1

    def grid(d: str) -> Column:
        low, high = edge[f"min_{d}"] or 0.0, edge[f"max_{d}"] or 0.0
        return F.floor((F.coalesce(F.col(d).cast("double"), F.lit(0.0)) - F.lit(low)) / F.lit(high - low) * top).cast("long") if high > low else F.lit(0).cast("long")

    tie = F.pmod(F.xxhash64("point", F.lit(1)), F.lit(1 << (POSITION_BITS - GRID_BITS)))
    state = durable(points.select("point", "weight", tie.alias("tie"), *[grid(d).alias(d) for d in dims]).withColumn("node", F.lit(0).cast("long")))
    tree = points.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(shards).cast("long").alias("room"))  # a node, and how many shards it may become
    axis = lambda: F.element_at(F.array(*dims), F.col("axis") + 1)
    position = lambda: F.shiftleft(axis(), POSITION_BITS - GRID_BITS) + F.col("tie")
    while True:
        spread = [(F.max(d) - F.min(d)).alias(f"spread_{d}") for d in dims]
        found = state.groupBy("node").agg(F.sum("weight").alias("bytes"), F.count("*").alias("points"), *spread)
        nodes = durable(found.join(tree, "node"))
        split = (F.col("room") > 1) & (F.col("bytes") > F.lit(target_bytes * TOLERANCE)) & (F.col("points") > 1)
        opened = nodes.where(split)
        number = opened.count()
        if not number:
            break
        widest = F.greatest(*[F.col(f"spread_{d}") for d in dims]) if len(dims) > 1 else F.col(f"spread_{dims[0]}")
        chosen = F.coalesce(*[F.when(F.col(f"spread_{d}") == widest, F.lit(i)) for i, d in enumerate(dims)])
        half = F.floor((F.col("room") + 1) / 2).cast("long")
        plan = opened.select("node", "room", half.alias("half"), chosen.alias("axis"), (F.col("bytes") * half / F.col("room")).alias("want"))
        placed = state.join(_nodes(plan.select("node", "axis"), number), "node").select(F.col("node").alias("key"), position().alias("position"), F.col("weight").alias("size"))
        cuts = cut_points(placed, plan.select(F.col("node").alias("key"), "want"))
        steps = plan.join(cuts, F.col("node") == F.col("key"), "left").select("node", "axis", "half", F.coalesce("below", F.lit(1 << POSITION_BITS)).alias("below"))
        beyond = F.coalesce(position() >= F.col("below"), F.lit(False))
        moved = state.join(_nodes(steps, number), "node", "left").withColumn("to", F.when(beyond, F.col("node") + F.col("half")).otherwise(F.col("node")))
        state = durable(moved.select("point", "weight", "tie", *dims, F.col("to").alias("node")))
        left, right = plan.select("node", F.col("half").alias("room")), plan.select((F.col("node") + F.col("half")).alias("node"), (F.col("room") - F.col("half")).alias("room"))
        tree = nodes.where(~split).select("node", "room").unionByName(left).unionByName(right)
    # A row a shard: numbered in the order of the tree.
    numbers = nodes.select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("int").alias("shard"))
    return state.join(_nodes(numbers, nodes.count()), "node").select("point", "weight", "shard")


def shard_rows(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row of ``docs``; shards have near-equal bytes.

    Give the number of shards, or the bytes that one should have (256 MB without either).
    Rows with equal texts share a shard (null texts are one group). Slots count from 0 in
    each shard without gaps. A null text has size 1 and checksum 0; nulls elsewhere count as
    0; texts count as their bytes, valid UTF-8 or not. Repeated rows stay, each with a slot
    of its own. Ids keep their type. There are fewer shards where there are fewer groups or
    one group outweighs a shard. Other columns are ignored whatever their names. An empty
    table gives an empty result.
    """
    text = F.col(text_col)
    point = F.when(text.isNotNull(), F.xxhash64(text.cast("binary"))).otherwise(F.lit(0))
    number = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    rows = durable(docs.select(F.col(id_col).alias("id"), byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), point.alias("point"), number(source_col).alias("source_number"), number(lang_col).alias("lang_number")))
    id_number = F.coalesce(F.expr("try_cast(cast(id AS STRING) AS DOUBLE)"), F.lit(0.0))
    points = durable(rows.groupBy("point").agg(F.sum("size").alias("weight"), F.count("*").alias("copies"), F.log2(F.min("size")).alias("bytes"), F.min("source_number").alias("source"), F.min("lang_number").alias("lang"), F.min(id_number).alias("number")))
    whole = points.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    if shards is None:
        shards = max(1, ceil(whole["bytes"] / (target_bytes or 1 << 28)))
    placed = kd_shards(points, ["bytes", "source", "lang", "number"], shards, whole["bytes"] / shards)
    hot = points.where((F.col("copies") > whole["rows"] * HOT_SHARE) & (F.col("copies") > 64)).select("point")
    return with_slots(_spread_join(rows, placed.select("point", "shard"), hot), shards, whole["rows"])


def _spread_join(rows: DataFrame, placed: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with their shard. Rows of hot points stay where they are and meet a broadcast table, so that no task gets all copies of a text."""
    kept = ["id", "size", "text_crc32", "shard"]
    if not hot.limit(1).count():
        return rows.join(placed, "point").select(kept)
    known = rows.join(F.broadcast(placed.join(F.broadcast(hot), "point")), "point").select(kept)
    return known.unionByName(rows.join(F.broadcast(hot), "point", "left_anti").join(placed, "point").select(kept))


def with_slots(placed: DataFrame, shards: int, n: int) -> DataFrame:
    """``placed`` (``n`` rows) with gapless slots: rows are numbered within small hash buckets of a shard, which follow one another; equal rows are one unit with as many slots as there are of them."""
    units = durable(placed.groupBy("shard", "id", "text_crc32", "size").agg(F.count("*").alias("n")))
    buckets = max(64, ceil(n / max(1, shards) / SLOT_ROWS))
    rows = units.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)))
    sums = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "bucket", F.coalesce(F.sum("n").over(before("shard").orderBy("bucket")), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("n").over(before("shard", "bucket").orderBy("id", "text_crc32", "size")), F.lit(0))
    first = rows.withColumn("inner", inner).join(starts, ["shard", "bucket"]).withColumn("first", F.col("start") + F.col("inner"))
    kept = ["id", "size", "text_crc32", "shard"]
    spread = lambda df: df.select(*kept, F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    if not units.where(F.col("n") > SLOT_ROWS).limit(1).count():
        return spread(first)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_ROWS).cast("long")))
    many = first.where(F.col("n") > SLOT_ROWS).select(*kept, "first", "n", parts.alias("part"))
    many = many.select(*kept, (F.col("first") + F.col("part")).alias("first"), F.least(F.col("n") - F.col("part"), F.lit(SLOT_ROWS)).alias("n"))
    return spread(first.where(F.col("n") <= SLOT_ROWS)).unionByName(spread(many.repartition("first")))
