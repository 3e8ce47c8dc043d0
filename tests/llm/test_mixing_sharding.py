import math
import zlib
from collections import defaultdict

import pytest
from helpers import SCHEMA, WORD, edge_rows, edge_table, prose
from pyspark.sql import functions as F

from quirelake.llm import mixing, sharding
from quirelake.llm.queries import op8_source_mixing, op9_kd_sharding


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares dealt again until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def taken_of(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += r.taken
    return out


def mix(spark, df):
    m = mixing.mixture(df)
    return mixing.with_copies(df, m, "mix").withColumn("words", mixing.word_count(F.col("text"))).select("doc_id", "source", F.col("words"), "mix.copies", "mix.target", (F.col("words") * F.col("mix.copies")).alias("taken")).collect()


@pytest.mark.parametrize("counts", [{"a": 300, "b": 10, "c": 10}, {"b": 100, "a": 1, None: 50, "z": 7, "é": 20}, {"x": 40}, {f"s{i}": 5 + i for i in range(12)}])
def test_mix_against_plain_targets(spark, counts):
    rows = [(k * 1000 + i, prose(i, 1 + i % 9), "en", s, 1) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mix(spark, df)
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        n = len(WORD.findall(t))
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want, taken = plain_targets(sizes), taken_of(found)
    assert all(r.target == pytest.approx(want[r.source]) for r in found)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 and taken[s] <= 2 * sizes[s] for s in sizes)
    assert all(0 <= r.copies <= 2 for r in found) and len(found) == len(rows)
    assert sorted((r.doc_id, r.taken) for r in mix(spark, df.repartition(5))) == sorted((r.doc_id, r.taken) for r in found)


def test_thresholds_are_nested(spark):
    df = spark.createDataFrame([(i, prose(i, 5), "en", "a" if i % 2 else "b", 1) for i in range(400)], SCHEMA)
    small = mixing.with_copies(df, mixing.mixture(df, share=0.4), "m").where("m.copies > 0").select("doc_id")
    large = mixing.with_copies(df, mixing.mixture(df, share=0.7), "m").where("m.copies > 0").select("doc_id")
    assert small.subtract(large).count() == 0 and small.count() < large.count()


def test_mix_edge_rows(spark):
    found = mix(spark, edge_table(spark))
    assert len(found) == len(edge_rows())
    assert all(r.taken <= 2 * r.words for r in found)
    assert mix(spark, spark.createDataFrame([], SCHEMA)) == []
    assert [r.target for r in mix(spark, spark.createDataFrame([(1, None, None, "a", 0)], SCHEMA))] == [0.0]


def test_mixing_stays_in_the_jvm(spark, sf_dir):
    plan = op8_source_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def check_shards(rows, shards):
    """Slots without gaps, equal texts together."""
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards", [1, 2, 3, 5, 8])
def test_shards_are_near_equal(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_rows(docs, shards=shards).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    check_shards(rows, shards)
    size, shard_of = defaultdict(int), defaultdict(set)
    for r in rows:
        raw = text[r.id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        size[r.shard] += r.size
        shard_of[raw].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    mean = sum(size.values()) / shards
    assert len(size) == shards and all(abs(s - mean) < 0.02 * mean for s in size.values())
    again = sharding.shard_rows(docs.repartition(3), shards=shards).collect()
    assert sorted((r.id, r.shard, r.slot) for r in again) == sorted((r.id, r.shard, r.slot) for r in rows)


def test_target_bytes(spark):
    docs = spark.createDataFrame([(i, prose(i, 20), "en", f"s{i % 3}", 1) for i in range(300)], SCHEMA)
    rows = sharding.shard_rows(docs, target_bytes=5000).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r.size
    assert len(size) == -(-sum(size.values()) // 5000) and max(size.values()) < 6000


def test_leaves_stop_at_the_target_bytes(spark):
    """A node within the target is a shard, though there is room for more of them; numbers have no gaps."""
    points = spark.createDataFrame([(i, 10, float(i), float(i % 7)) for i in range(160)], "point long, weight long, x double, y double")
    sizes = lambda shards, target: sorted(r["sum(weight)"] for r in sharding.kd_shards(points, ["x", "y"], shards, target).groupBy("shard").agg(F.sum("weight")).collect())
    assert sizes(8, 200) == [200] * 8 and sizes(64, 200) == [200] * 8 and sizes(64, 400) == [400] * 4 and sizes(3, 1) == [530, 530, 540]
    numbers = {r.shard for r in sharding.kd_shards(points, ["x", "y"], 64, 400).collect()}
    assert numbers == {0, 1, 2, 3}


def plain_tree(points, room, target):
    """{point: shard} by the same splits, on sorted lists: widest dimension, ties by hash, the cut nearest to the wanted bytes."""
    dims = range(len(points[0][2])) if points else ()
    low, high = [min(p[2][d] for p in points) for d in dims], [max(p[2][d] for p in points) for d in dims]
    top = (1 << sharding.GRID_BITS) - 1
    grid = {p[0]: [math.floor((p[2][d] - low[d]) / (high[d] - low[d]) * top) if high[d] > low[d] else 0 for d in dims] for p in points}

    def split(points, room):
        total = sum(p[1] for p in points)
        if room < 2 or total <= target * sharding.TOLERANCE or len(points) < 2:
            return [points]
        spread = [max(grid[p[0]][d] for p in points) - min(grid[p[0]][d] for p in points) for d in dims]
        axis, half = spread.index(max(spread)), (room + 1) // 2
        points = sorted(points, key=lambda p: (grid[p[0]][axis], p[3]))
        want, run, cut = total * half / room, 0, len(points)
        for k, p in enumerate(points):
            if run <= want < run + p[1]:
                cut = k + (2 * (want - run) > p[1])
                break
            run += p[1]
        return split(points[:cut], half) + split(points[cut:], room - half)

    return {p[0]: k for k, part in enumerate(x for x in split(points, room) if x) for p in part}


@pytest.mark.parametrize("shards", [3, 8])
def test_shards_are_those_of_a_plain_tree(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    point = F.xxhash64(F.col("text").cast("binary"))
    number = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumn("size", sharding.byte_size(F.col("text"))).withColumn("point", point)
    grouped = rows.groupBy("point").agg(F.sum("size").alias("weight"), F.log2(F.min("size")).alias("bytes"), F.min(number("source")).alias("source"), F.min(number("lang")).alias("lang"), F.min(F.col("doc_id").cast("double")).alias("number"))
    tie = F.pmod(F.xxhash64("point", F.lit(1)), F.lit(1 << (sharding.POSITION_BITS - sharding.GRID_BITS)))
    points = [(r.point, r.weight, (r.bytes, r.source, r.lang, r.number), r.tie) for r in grouped.withColumn("tie", tie).collect()]
    want = plain_tree(points, shards, sum(p[1] for p in points) / shards)
    of = {r.doc_id: r.point for r in rows.collect()}
    found = {r.id: r.shard for r in sharding.shard_rows(docs, shards=shards).collect()}
    assert found == {i: want[p] for i, p in of.items()}


def test_equal_rows_are_dealt_out(spark, monkeypatch):
    """A third of all rows alike, their id included: each has a slot, made in parts."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 30)
    monkeypatch.setattr(sharding, "HOT_SHARE", 0.05)
    docs = spark.createDataFrame([(7, "the same", "en", "a", 1)] * 130 + [(100 + i, prose(i, 9), "en", "b", 1) for i in range(260)], SCHEMA)
    rows = sharding.shard_rows(docs, shards=3).collect()
    check_shards(rows, 3)
    assert len(rows) == 390 and len({r.shard for r in rows if r.id == 7}) == 1 and len({(r.shard, r.slot) for r in rows}) == 390


def test_one_heavy_group(spark):
    same = prose(1, 30)
    docs = spark.createDataFrame([(i, same if i % 3 == 0 else prose(i, 30), "en", "a", 1) for i in range(300)], SCHEMA)
    rows = sharding.shard_rows(docs, shards=8).collect()
    check_shards(rows, 8)
    assert len({r.shard for r in rows if r.id % 3 == 0}) == 1 and len(rows) == 300


def test_shard_edge_rows(spark):
    rows = sharding.shard_rows(edge_table(spark), shards=4).collect()
    assert len(rows) == len(edge_rows())
    check_shards(rows, 4)
    by_id = {r.id: r for r in rows}
    assert (by_id[2].size, by_id[2].text_crc32) == (1, 0) and by_id[5].shard == by_id[6].shard
    assert sharding.shard_rows(spark.createDataFrame([], SCHEMA), shards=8).count() == 0


def test_sharding_stays_in_the_jvm(spark, sf_dir):
    df = op9_kd_sharding(spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.count() == 200
