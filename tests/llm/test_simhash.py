import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from helpers import SCHEMA, WORD, components, edge_rows, edge_table, lower_ascii, prose
from pyspark.sql import functions as F

from quirelake.llm import simhash
from quirelake.llm.components import connected_components


def plain_fingerprint(text):
    words = WORD.findall(lower_ascii(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = {}
    for i, text in rows:
        prints[i] = plain_fingerprint(text)
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    return prints, components(prints, links)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two three", "A b C d", "the same the same the same the same", "é 😀 x y z", prose(3, 500)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_every_close_pair_shares_a_probe(segments):
    plan = simhash.segment_plan(4, segments)
    r = random.Random(segments)
    for _ in range(2000):
        flips = 0
        for b in r.sample(range(64), r.randint(0, 4)):
            flips |= 1 << b
        assert any((flips >> shift & (1 << width) - 1).bit_count() <= ball for shift, width, ball in plan)


@pytest.mark.parametrize("segments", [2, 3, 5])
def test_links_connect_what_brute_force_connects(spark, segments):
    r = random.Random(segments)
    prints = set()
    for _ in range(30):
        centre = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            x = centre
            for b in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << b
            prints.add(x)
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(row.a, row.b) for row in simhash.hamming_links(df, 4, segments).collect()]
    near = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 4]
    assert components(signed, links) == components(signed, near)
    assert all(((a ^ b) % 2**64).bit_count() <= 64 for a, b in links)


def test_dense_group_sends_a_forest(spark):
    signed = [1 << b for b in range(40)]  # all within two bits of each other
    links = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, 3)
    assert links.count() < len(signed) * (len(signed) - 1) / 2 / 2
    assert len(set(components(signed, [(r.a, r.b) for r in links.collect()]).values())) == 1


def test_groups_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prints, parts = plain_groups([tuple(r) for r in docs.collect()])
    rows = simhash.simhash_groups(docs).withColumn("hex", simhash.fingerprint_hex(F.col("fp"))).collect()
    assert {r.id: r.hex for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.id: r.component_id for r in rows} == parts
    assert len(set(parts.values())) < len(parts)


def test_edge_rows(spark):
    rows = simhash.simhash_groups(edge_table(spark)).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r.id: r for r in rows}
    assert by_id[2].component_id == by_id[3].component_id == by_id[4].component_id == 2 and by_id[2].fp == 0
    assert by_id[5].component_id == by_id[6].component_id == 5
    assert by_id[None].component_id is None
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (3, 4), (4, 5), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 5)], [(3, 1), (1, 3), (3, 1)]])
def test_components(spark, links):
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == components(nodes, links) if nodes else found == {}


def test_random_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    found = {x.node: x.component for x in connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long"), "a", "b").collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == {n: c for n, c in components({x for p in links for x in p}, links).items() if n in nodes}
