import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from helpers import SCHEMA, WORD, components, edge_rows, edge_table, lower_ascii, prose

from quirelake.llm import near


def shingles(text):
    w = WORD.findall(lower_ascii(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    """Jaccard similarity of 0.8 or more; empty sets are alike."""
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_similar_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    return components(sets, [p for p in combinations(sets, 2) if alike(sets[p[0]], sets[p[1]])])


def changed_texts():
    """Texts with passages appended, put before or cut off, and single words changed, on both sides of 0.8."""
    rows = []
    for k in range(40):
        r, words = random.Random(k), prose(k, 30 + 11 * k).split()
        n = len(words)
        rows.append((100 * k, " ".join(words)))
        for c, share in enumerate((0.02, 0.1, 0.18, 0.24, 0.26, 0.35)):
            m = max(1, int(share * n))
            extra = prose(1000 + 10 * k + c, m).split()
            edits = list(words)
            for at in r.sample(range(n), max(1, m // 8)):
                edits[at] = f"new{at}"
            for v, w in enumerate((words + extra, extra + words, words[: n - m], words[m:], edits)):
                rows.append((100 * k + 10 * c + v + 1, " ".join(w)))
    return rows


def test_links_of_every_band_are_found(spark):
    """Of pairs in each band from 0.8 up, by appended, prefixed and cut passages and by edits, at least 0.95 share a group, and none below does without a chain."""
    rows = changed_texts()
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets, [p for p in combinations(sets, 2) if alike(sets[p[0]], sets[p[1]])])
    found = {r.id: r.component_id for r in near.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bands = {}
    for a, b in combinations(sets, 2):
        if a // 100 == b // 100 and (j := len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))) >= 0.8:
            bands.setdefault(int(j * 20), []).append(found[a] == found[b])
    assert set(bands) >= {16, 17, 18, 19} and all(sum(x) / len(x) >= 0.95 for x in bands.values()), {k: sum(x) / len(x) for k, x in bands.items()}
    assert all(want[i] == want[found[i]] for i in sets)  # what shares a group does so by force too
    assert 40 < len(set(want.values())) < len(rows) / 2


def test_pairs_alone_are_found_in_every_band():
    """Pairs without a third text to connect them: the fingerprints' balls and distances let 0.95 of each band through."""
    shape = near.index_shape(1000)
    width, segments, _ = shape
    lanes = near.lanes_of(shape)
    bands = {}
    for k in range(1500):
        r, words = random.Random(k), prose(k, 40 + 7 * (k % 60)).split()
        n, share = len(words), r.uniform(0.01, 0.25)
        m = max(1, int(share * n))
        extra = prose(10_000 + k, m).split()
        edits = list(words)
        for at in r.sample(range(n), max(1, m // 10)):
            edits[at] = f"new{at}"
        other = (words + extra, extra + words, words[: n - m], edits)[k % 4]
        a, b = " ".join(words), " ".join(other)
        x, y = shingles(a), shingles(b)
        j = len(x & y) / len(x | y)
        if j >= 0.8:
            p, q = (np.frombuffer(near.wide_fingerprint(near.shingle_hashes(t), lanes), np.uint8).reshape(1, -1) for t in (a, b))
            met = any((int(near._segment(p, s, width)[0]) ^ int(near._segment(q, s, width)[0])).bit_count() <= 1 for s in range(segments))
            far = int(np.bitwise_count(p ^ q).sum())
            first = int(np.bitwise_count(p[:, :8] ^ q[:, :8]).sum())
            bands.setdefault(int(j * 20), []).append(met and far <= near.distance_limit(64 * lanes) and first <= near.distance_limit(64))
    assert all(len(x) > 100 and sum(x) / len(x) >= 0.95 for x in bands.values()), {k: (len(x), sum(x) / len(x)) for k, x in bands.items()}


def found_share(n, words, kind, pairs=250):
    """Of pairs of texts of about so many words, alike by 0.8 or a little more, those that an index of ``n`` texts finds, and how many pairs there were."""
    shape = near.index_shape(n)
    width, segments, _ = shape
    lanes = near.lanes_of(shape)
    place = (np.arange(segments)[:, None] * width + np.arange(width)).ravel()
    found = total = 0
    for k in range(pairs):
        r = random.Random(1000 * words + k)
        a = prose(7 * k + words, words).split()
        most = max(m for m in range(words) if alike(shingles(" ".join(a)), shingles(" ".join(changed(r, a, m, kind)))))
        if not most:
            continue
        b = changed(r, a, most, kind)
        x, y = (np.unpackbits(np.frombuffer(near.wide_fingerprint(near.shingle_hashes(" ".join(t)), lanes), np.uint8)) for t in (a, b))
        apart = x != y
        met = (apart[place].reshape(segments, width).sum(axis=1) <= 1).any()
        found += met and apart.sum() <= near.distance_limit(64 * lanes) and apart[:64].sum() <= near.distance_limit(64)
        total += 1
    return found / max(1, total), total


def changed(r, words, m, kind):
    """``m`` words put behind or cut off the end, or one word changed for each five of ``m``."""
    if kind == "append":
        return words + [f"more{k}" for k in range(m)]
    if kind == "cut":
        return words[: len(words) - m] if m < len(words) else words[:1]
    return [*words[: len(words) - m], *(f"new{k}" for k in range(m))]


@pytest.mark.parametrize("n", [10**4, 10**6, 10**9, 2 * 10**10])
def test_short_texts_are_found_at_any_size(n):
    """Texts of 8 to 30 words (below 8 only equal sets are 0.8 alike): 0.95 of the pairs that are hardest to find, however many texts there are."""
    shares = {(words, kind): found_share(n, words, kind, 60 if n > 10**6 else 150) for words in (8, 9, 12, 13, 16, 20, 25, 30) for kind in ("append", "cut", "replace")}
    shares = {k: v for k, v in shares.items() if v[1]}
    total = sum(t for _, t in shares.values())
    assert len(shares) >= 16 and sum(s * t for s, t in shares.values()) / total >= 0.95 and min(s for s, _ in shares.values()) >= 0.9, shares


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = plain_similar_groups([tuple(r) for r in docs.collect()])
    assert {r.id: r.component_id for r in near.similar_groups(docs).collect()} == want


def test_stage_drops_an_appended_copy(spark, sf_dir):
    text = prose(7, 200)
    rows = [(1, text, "en", "a", 1), (2, f"{text} {prose(8, 45)}", "en", "a", 1), (3, f"{text} {prose(9, 60)}", "en", "a", 1)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted(r.doc_id for r in left) == [1, 3]


def test_forests_span_and_prefer_close_pairs():
    r = np.random.default_rng(3)
    links = np.stack([r.integers(0, 9, 400), r.integers(0, 60, 400), r.integers(60, 120, 400)], 1)
    kept = near.spanning(links, 1)
    nodes = set(links[:, 1:].ravel().tolist())
    everything = components(nodes, links[:, 1:].tolist())
    assert components(nodes, kept[:, 1:].tolist()) == everything and len(kept) == len(nodes) - len(set(everything.values()))
    # The least sum, by taking links in order.
    root, total = {n: n for n in nodes}, 0
    for d, a, b in sorted(map(tuple, links.tolist())):
        if root[a] != root[b]:
            total += d
            old = root[b]
            root = {n: root[a] if x == old else x for n, x in root.items()}
    assert kept[:, 0].sum() == total
    assert len(near.spanning(links, 2)) > len(kept) and len(near.spanning(links[:0])) == 0


@pytest.mark.parametrize("shape", [(16, 16, 0), (16, 16, 2), (20, 26, 3), (24, 30, 1)])
def test_pairs_of_any_shape(spark, shape):
    """Ranges, salts and lookups from other ranges meet every pair within one bit of a segment, once."""
    r = random.Random(shape[2])
    bits = 64 * near.lanes_of(shape)
    prints = {}
    for c in range(25):
        centre = r.getrandbits(bits)
        for v in range(3):
            x = centre
            for b in r.sample(range(bits), v * bits // 12):
                x ^= 1 << b
            prints[1000 * r.getrandbits(30) + 3 * c + v] = x.to_bytes(bits // 8, "big")
    df = spark.createDataFrame([(n, bytearray(p)) for n, p in prints.items()], "node long, fp binary")
    segment = lambda p, k: int.from_bytes(p, "big") >> (bits - (k + 1) * shape[0]) & ((1 << shape[0]) - 1)
    far = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    lane = lambda a, b: far(a[:8], b[:8])
    want = {(a, b) for a, b in combinations(sorted(prints), 2) if far(prints[a], prints[b]) <= near.distance_limit(bits) and lane(prints[a], prints[b]) <= near.distance_limit(64) and any((segment(prints[a], k) ^ segment(prints[b], k)).bit_count() <= 1 for k in range(shape[1]))}
    found = {(x.a, x.b) for x in near.candidates(df, shape).collect()}
    assert found <= want and components(prints, found) == components(prints, want) and len(want) > 20


def test_shape_follows_the_number_of_texts():
    for n in (0, 1, 10**5, 10**6, 10**7, 10**9, 10**11):
        width, segments, top = near.index_shape(n)
        assert n / 2**width <= 32 and n / 2**top <= near.RANGE and top < width <= 32


def test_edge_rows(spark):
    rows = near.similar_groups(edge_table(spark)).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r.id: r.component_id for r in rows}
    assert by_id[2] == by_id[3] == by_id[4] == 2 and by_id[5] == by_id[6] == 5 and by_id[None] is None and by_id[1] == 1 and by_id[9] == 9
    assert near.similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_id_on_several_texts(spark):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(2, 50) + " end"), (None, prose(1, 50) + " end")]
    found = sorted((str(r.id), r.component_id) for r in near.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [("1", 1), ("1", 1), ("2", 1), ("None", 1)]


def test_links_behind_refused_pairs_are_found(spark):
    """Two sets that are 0.8 alike among many parts of theirs, as close to both by their fingerprints but 0.79 alike at most: forests alone leave the link out."""
    rows, ends = [], []
    for k in range(20):
        r = random.Random(k)
        shared, own = [f"s{k}x{i}" for i in range(360)], [[f"{c}{k}x{i}" for i in range(45)] for c in "ab"]
        texts = [shared + own[0], shared + own[1], *(r.sample(shared, 318) for _ in range(14))]
        ends.append((100 * k, 100 * k + 1))
        rows += [(100 * k + i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: frozenset(t.split()) for i, t in rows}
    assert all(alike(sets[a], sets[b]) for a, b in ends) and not any(alike(sets[a], sets[c]) for a, b in ends for c in range(b + 1, b + 15))
    groups = {r.id: r.component_id for r in near.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()}
    assert sum(groups[a] == groups[b] for a, b in ends) >= 19
    plain = components(sets, [p for k in range(20) for p in combinations(range(100 * k, 100 * k + 16), 2) if alike(sets[p[0]], sets[p[1]])])
    assert all(plain[i] == plain[groups[i]] for i in sets)


def test_pairs_of_a_dense_group_are_not_sent(spark):
    """Each of 400 fingerprints is close to each other: rows sent grow with the members, and whatever isn't sent has both ends named."""
    r = random.Random(4)
    shape = (16, 16, 0)
    bits = 64 * near.lanes_of(shape)
    centre = r.getrandbits(bits)
    sent = {}
    for m in (100, 400):
        prints = {r.getrandbits(40): (centre ^ sum(1 << b for b in r.sample(range(bits), 15))).to_bytes(bits // 8, "big") for _ in range(m)}
        far = next(iter(prints)) + 1  # meets one of them in one segment only
        alone = np.frombuffer(next(iter(prints.values())), np.uint8).copy()
        alone[2:32:2] ^= 3
        prints[far] = alone.tobytes()
        df = spark.createDataFrame([(n, bytearray(p), n) for n, p in prints.items()], "node long, fp binary, group long")
        rows = near.candidates(df, shape).collect()
        named, pairs = {x.a for x in rows if x.a == x.b}, {(x.a, x.b) for x in rows if x.a < x.b}
        near_by = lambda a, b: all(np.bitwise_count(np.frombuffer(prints[a][:k], np.uint8) ^ np.frombuffer(prints[b][:k], np.uint8)).sum() <= near.distance_limit(8 * k) for k in (8, bits // 8))
        segment = lambda n: {(k, prints[n][2 * k : 2 * k + 2]) for k in range(16)}
        cut = {n: segment(n) for n in prints}
        want = {(a, b) for a, b in combinations(sorted(prints), 2) if cut[a] & cut[b] and near_by(a, b)}  # a part of them: equal in a segment
        assert len(want) > m * m / 8 and all(x in pairs or named.issuperset(x) for x in want)
        sent[m] = len(rows)
    assert sent[400] < 2 * near.FEW * 400 * 16 and sent[400] < 5 * sent[100], sent


@pytest.mark.parametrize("members, hashes", [(1024, 1 << 19), (16, 1 << 19), (1024, 4096)])
def test_links_within_a_dense_group_are_found(spark, monkeypatch, members, hashes):
    """Ten links among 150 parts of one text, all as close by their fingerprints, whether one block holds them or many; no other link is made."""
    monkeypatch.setattr(near, "MEMBERS", members)
    monkeypatch.setattr(near, "HASHES", hashes)
    r = random.Random(9)
    shared = [f"s{i}" for i in range(360)]
    rows = [(i, " ".join(r.sample(shared, 318) + [f"a{i}x{k}" for k in range(20)])) for i in range(150)]
    for k in range(10):
        words = rows[k][1].split()
        rows.append((1000 + k, " ".join(words[: len(words) - 30] + [f"b{k}x{i}" for i in range(12)])))
    sets = {i: frozenset(t.split()) for i, t in rows}
    want = components(sets, [p for p in combinations(sets, 2) if alike(sets[p[0]], sets[p[1]])])
    assert 5 <= len(sets) - len(set(want.values())) < len(sets) / 4
    assert {x.id: x.component_id for x in near.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()} == want


def test_blocks_join_groups_once(spark):
    """Each set of a block that is alike all others gives as many links as join the groups, and groups of one number stay unasked."""
    sets = [near.shingle_hashes(" ".join(f"w{i}" for i in range(40 + k)), 1) for k in range(9)]
    fp = bytearray(near.wide_fingerprint(sets[0], 4))
    rows = [(k, 7, k // 2, fp, bytearray(h.tobytes())) for k, h in enumerate(sets)] + [(20, 8, 20, fp, bytearray(sets[0].tobytes()))]
    links = near.dense_links(spark.createDataFrame(rows, "node long, whole long, group long, fp binary, set binary"), 256).collect()
    assert len(links) == 4 and len(set(components(range(5), [(x.a // 2, x.b // 2) for x in links]).values())) == 1
