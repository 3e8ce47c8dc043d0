import math
import random
import re
from collections import Counter

import pytest
from helpers import SCHEMA, edge_rows, edge_table, lower_ascii

from quirelake.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall(lower_ascii(text))


def plain_search(docs, items, k=10):
    """(item, rank, id, score) by scoring every document for every item."""
    found = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    holding = Counter(t for _, ts in found for t in set(ts))
    counts = [(i, Counter(ts), len(ts)) for i, ts in found]
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c, length in counts:
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * length * n // total))) for t, times in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found_by(docs, items, *more):
    return sorted((tuple(r) for r in search.search(docs, items, *more).collect()), key=str)


def made(seed, documents=400, items=12):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["É", "naïve", "Ünï"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: r.choice([" ", "-", ", "]).join(w.upper() if r.random() < 0.2 else w for w in r.choices(words, weights, k=n))
    docs = [(i, text(r.choice([0, 1, 5, 40, 200]))) for i in range(documents)]
    return docs + docs[:5] + [(None, text(9)), (3, text(30))], [(i, text(r.randint(1, 40))) for i in range(items)]


def test_terms():
    text = "Don't_stop ÀÉ-naïve 12ab\x7f;x:9   😀end İZ@Q[z{"
    assert [t.decode() for t in search.terms_of(text.encode())] == terms(text) and search.terms_of(None) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = made(seed)
    d, q = spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS)
    assert found_by(d, q) == plain_search(docs, items)
    assert found_by(d, q, 3) == plain_search(docs, items, 3)


def test_pieces_blocks_and_shuffled_joins_give_the_same(spark, monkeypatch):
    docs, items = made(3)
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for name, value in (("LISTS", 40), ("PART", 50), ("CELLS", 1), ("ENTRIES", 200), ("sent", lambda keys: keys)):
        monkeypatch.setattr(search, name, value)
    assert found_by(d, q) == plain_search(docs, items)


def test_few_candidates_reach_the_last_phase(spark, monkeypatch):
    """A passage stands in ten documents of a thousand: only these are looked up."""
    r = random.Random(9)
    passage = " ".join(f"rare{k}" for k in range(30))
    docs = [(i, " ".join(r.choices(["the", "of", "and", "in"], k=60)) + (f" {passage}" if i % 100 == 7 else f" only{i}")) for i in range(1000)]
    items = [(1, passage + " the of")]
    looked = []
    monkeypatch.setattr(search, "sent", lambda keys: looked.append(keys.count()) or keys)
    assert found_by(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)) == plain_search(docs, items) and looked == [10]


def test_edge_cases(spark):
    docs = [(i, t) for i, t, *_ in edge_rows()]
    items = [(1, "quick brown FOX"), (None, "without id"), (2, None), (3, "!!"), (4, "absent"), (1, "lazy dog"), (5, "été a 12345"), (6, "er th")]
    clash = "1 AS term", "1 AS row", "'x' AS n", "1 AS tf", "1 AS item", "1 AS impact", "1 AS score"
    found = found_by(edge_table(spark).selectExpr("*", *clash), spark.createDataFrame(items, ITEMS).selectExpr("*", *clash))
    assert found == plain_search(docs, items) and {x[0] for x in found} == {1, None, 5, 6}
    assert [x[2] for x in found if x[0] == 5].count(7) == 2  # repeated rows are documents of their own


def test_empty_tables(spark):
    some_docs, some_items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert found_by(spark.createDataFrame([], SCHEMA), some_items) == [] == found_by(some_docs, spark.createDataFrame([], ITEMS))
    assert found_by(spark.createDataFrame([(1, None), (2, "; ;")], DOCS), some_items) == []


def test_ids_of_another_type_and_invalid_text(spark):
    docs = spark.createDataFrame([("b", bytearray(b"word \xff")), ("a", bytearray("word �".encode())), ("c", bytearray(b"other text here"))], "doc_id string, raw binary").selectExpr("doc_id", "CAST(raw AS string) AS text")
    assert [x[1:3] for x in found_by(docs, spark.createDataFrame([("q", "word")], "item_id string, text string"))] == [(1, "a"), (2, "b")]


def test_postings_are_deleted(spark, tmp_path):
    from pathlib import Path

    from quirelake.durable import ensure_checkpoint_dir

    docs, items = made(4, 30, 2)
    search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert not list(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("postings-*"))
