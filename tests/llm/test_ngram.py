import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, WORD, edge_rows, edge_table, lower_ascii
from pyspark.sql import functions as F

from quirelake.llm import ngram
from quirelake.llm.queries import op5_lm_scoring


def tokens(text):
    return [*WORD.findall(lower_ascii(text)), None]


def test_query_against_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ngram, "CHUNK", 2000)
    docs = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    left = {i: zlib.crc32(str(i).encode()) % 7 for i in docs}
    counts = Counter(t for i, ts in docs.items() if left[i] != 2 for t in ts)
    total, known = sum(counts.values()), len(counts)
    rows = op5_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    better = []
    for r in rows:
        ts = docs[r.doc_id]
        base = sum(math.log10((counts[t] + 1) / (total + known + 1)) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (left[r.doc_id] == 2, len(ts), sum(counts[t] > 0 for t in ts), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        if r.held_out:
            better.append(r.score > base)
    assert sum(better) / len(better) > 0.8


def test_model_against_brute_force(spark):
    """Scores recomputed from plain counts with weights learned by the same EM on plain cells."""
    texts = {i: " ".join(np.random.default_rng(i).choice(["a", "b", "c", "d", f"w{i % 9}"], 12, p=[0.4, 0.3, 0.15, 0.1, 0.05])) for i in range(60)}
    kind = {i: [ngram.COUNTED, ngram.COUNTED, ngram.DELETED, ngram.UNSEEN][i % 4] for i in texts}
    df = spark.createDataFrame([(i, t, kind[i]) for i, t in texts.items()], "doc_id long, text string, k int")
    rows = {r.id: r for r in ngram.score_texts(df, F.col("k")).collect()}

    def count(classes):
        one, two = Counter(), Counter()
        for i, t in texts.items():
            if kind[i] in classes:
                ts = tokens(t)
                one.update(ts)
                two.update(zip([None, *ts], ts))
        return one, two

    one, two = count((0,))
    all_one, all_two = count((0, 1))
    known = len(all_one)
    bucket = lambda c: int(math.log2(c)) + 1 if c else 0
    held = [(bucket(one[v]), two[v, w] / one[v] if one[v] else 0.0, one[w] / sum(one.values())) for i, t in texts.items() if kind[i] == 1 for v, w in zip([None, *tokens(t)], tokens(t))]
    low = 64 * ngram.BINS + 1
    cell = np.array([b * low * low for b, *_ in held])
    weights = ngram.learn_weights(cell, np.ones(len(held)), np.array([p for _, p, _ in held]), np.array([p for *_, p in held]), 1 / (known + 1))
    n = sum(all_one.values())
    for i, t in texts.items():
        want = sum(math.log10(weights[bucket(all_one[v])] @ [all_two[v, w] / all_one[v] if all_one[v] else 0, all_one[w] / n, 1 / (known + 1)]) for v, w in zip([None, *tokens(t)], tokens(t)))
        assert rows[i].score == pytest.approx(want, rel=2e-3)
    # Each context's probabilities of the known words and one unknown add up to one.
    for v in all_one:
        total = sum(weights[bucket(all_one[v])] @ [all_two[v, w] / all_one[v], all_one[w] / n, 1 / (known + 1)] for w in all_one)
        assert total + weights[bucket(all_one[v])][2] / (known + 1) == pytest.approx(1)


@pytest.mark.parametrize(("level", "size"), [(2, 200), (3, 40), (1, 700)])
def test_levels_of_the_exchange_change_nothing(spark, sf_dir, monkeypatch, level, size):
    """Askers bundled over one or more levels get the counts that they get from the ranges themselves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).repartition(6)
    kind = F.when(F.col("doc_id") % 7 == 2, ngram.UNSEEN).when(F.col("doc_id") % 7 == 5, ngram.DELETED).otherwise(ngram.COUNTED)
    scored = lambda: {r.id: tuple(r)[1:] for r in ngram.score_texts(docs, kind).collect()}
    want = scored()
    monkeypatch.setattr(ngram, "LEVEL_BITS", level)
    monkeypatch.setattr(ngram, "RANGE", size)
    found = scored()
    assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_blocks_grow_with_the_tokens():
    """Blocks a chunk: at most 2**LEVEL_BITS for each level, of which there are as many as it takes to part the ranges."""
    for tokens in (10**8, 10**10, 10**13):
        bits = max(4, math.ceil(math.log2(tokens / ngram.RANGE)))
        assert -(-bits // ngram.LEVEL_BITS) <= 2 and 2 ** min(bits, ngram.LEVEL_BITS) <= 4096


def test_em_raises_held_out_likelihood():
    r = np.random.default_rng(2)
    n, p2, p1 = r.integers(1, 50, 40).astype(float), r.random(40), r.random(40) / 10
    cell = r.integers(0, 3, 40) * (64 * ngram.BINS + 1) ** 2
    w = ngram.learn_weights(cell, n, p2, p1, 0.001)
    loss = lambda w: sum(k * math.log(w[c // (64 * ngram.BINS + 1) ** 2] @ [a, b, 0.001]) for k, c, a, b in zip(n, cell, p2, p1) if c)
    assert np.allclose(w.sum(axis=1), 1) and loss(w) >= loss(np.full((66, 3), 1 / 3))


def test_edge_rows(spark):
    df = edge_table(spark)
    rows = ngram.score_texts(df, F.lit(ngram.COUNTED)).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r.id: r for r in rows}
    assert by_id[2].n_tokens == by_id[3].n_tokens == by_id[4].n_tokens == 1 and by_id[None].n_tokens == 4
    assert ngram.score_texts(spark.createDataFrame([], SCHEMA), F.lit(0)).count() == 0
    unseen = ngram.score_texts(df, F.lit(ngram.UNSEEN)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in unseen)


def test_blocks_come_back():
    keys = np.sort(np.random.default_rng(3).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(ngram._unpack_sorted(ngram._pack_sorted(keys)), keys)
    arrays = [np.arange(5, dtype=np.uint8), np.array([], np.int64), np.array([1 << 40], np.uint64)]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, ngram._unpack(ngram._pack(*arrays))))
