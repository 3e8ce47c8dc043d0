import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import components

from quirelake.llm import covertree
from quirelake.llm.queries import op7_embedding_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    centres = unit(r.normal(size=(max(1, n // 12), dim)))
    return unit(centres[r.integers(0, len(centres), n)] + r.normal(size=(n, dim)) * spread)


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.1, 0.3])
@pytest.mark.parametrize("dim", [2, 3, 16])
def test_tree_keeps_its_promises(spread, dim):
    p = clustered(1, 150, dim, spread)
    t = covertree.build(p)
    for k in range(1, t.depth):
        up = t.centre[k - 1][t.parent[k]]
        if k < t.depth - 1 or len(t.centre[k]) < len(p):
            assert (np.linalg.norm(p[t.centre[k]] - p[up], axis=1) <= 2.0 ** (2 - k) + 1e-9).all()
        assert set(t.centre[k - 1]) <= set(t.centre[k])  # nested
    assert len(t.centre[-1]) == len(p)
    for k in range(t.depth):
        for node, below in enumerate(covertree._points_below(t, k)):
            assert np.linalg.norm(p[below] - p[t.centre[k][node]], axis=1).max() <= t.radius[k][node] + 1e-9
    back = covertree.CoverTree.from_bytes(p, t.to_bytes())
    assert all(np.array_equal(a, b) for x, y in ((t.centre, back.centre), (t.parent, back.parent), (t.radius, back.radius)) for a, b in zip(x, y))


def pairs_of(left, right, cosine, same):
    found = []
    for x, y, whole in covertree.dual_traversal(left, right, cosine, same):
        found += [(i, j) for i in x.tolist() for j in y.tolist()] if whole else list(zip(x.tolist(), y.tolist()))
    return sorted((min(p), max(p)) for p in found) if same else sorted(found)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cosine", [0.5, 0.9, 0.999])
def test_exact_pairs(seed, cosine):
    spread, dim = [0.0, 0.01, 0.05, 0.1, 0.2, 0.5][seed], [2, 3, 8, 16, 32, 64][seed]
    a, b = clustered(seed, 120, dim, spread), clustered(seed, 90, dim, spread * 1.5)
    ta, tb = covertree.build(a), covertree.build(b)
    assert pairs_of(ta, ta, cosine, True) == [(i, j) for i, j in combinations(range(len(a)), 2) if a[i] @ a[j] >= cosine]
    assert pairs_of(ta, tb, cosine, False) == [tuple(x) for x in np.argwhere(a @ b.T >= cosine).tolist()]


def brute(vectors, cosine):
    ok = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    links = [(a, b) for a, b in combinations(sorted(ok), 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine]
    n = {i: sum(i in p for p in links) for i, _ in vectors}
    return n, components([i for i, _ in vectors], links)


@pytest.mark.parametrize("cell", [7, 50, 4096])
def test_table_against_brute_force(spark, cell):
    p = clustered(3, 160, 8, 0.08)
    rows = [(i, v.tolist()) for i, v in enumerate(p)] + [(200 + i, p[5].tolist()) for i in range(20)] + [(300, (p[5] * 3).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS first", "'y' AS cell", "1 AS id")
    given = [(r.vec_id, r.embedding) for r in df.collect()]
    n, parts = brute(given, 0.9)
    found = covertree.near_vectors(df, 0.9, cell).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (n[i], parts[i], parts[i] == i) for i, _ in given}


@pytest.mark.parametrize("scale", [1e-320, 1e-200, 1.0, 1e200, 1.5e308])
def test_any_magnitude(spark, scale):
    """Very small and very large vectors neither lose their own links nor those of others."""
    rows = [(1, [scale, 0.0, 0.0, 0.0]), (2, [1.0, 2.0, 3.0, 4.0]), (3, [1.0, 2.0, 3.0, 4.1]), (4, [scale, scale / 4, 0.0, 0.0]), (5, [0.0, 0.0, 1.0, -1.0])]
    found = {r.id: (r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (1, 1), 5: (0, 5)}


def test_each_length_is_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [1.0, 0.1, 0.0]), (6, [3.0]), (7, [-3.0]), (8, [5.0])]
    found = {r.id: (r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<float>")).collect()}
    assert found == {"1": (1, "1"), "2": (1, "1"), "3": (2, "3"), "4": (2, "3"), "5": (2, "3"), "6": (1, "6"), "7": (0, "7"), "8": (1, "6")}


@pytest.mark.parametrize(("group", "cell"), [(40, 9), (25, 100), (400, 50)])
def test_groups_of_blocks(spark, monkeypatch, group, cell):
    """Whatever the groups and blocks, a dense bunch included: each pair once."""
    monkeypatch.setattr(covertree, "GROUP", group)
    monkeypatch.setattr(covertree, "LEAST_GROUP", group)
    monkeypatch.setattr(covertree, "BLOCK", 50)
    monkeypatch.setattr(covertree, "GATHERED", 64)
    p = np.concatenate([clustered(8, 150, 6, 0.1), unit(np.ones((90, 6)) + np.random.default_rng(1).normal(size=(90, 6)) * 0.01)])
    rows = [(i, v.tolist()) for i, v in enumerate(p)]
    n, parts = brute(rows, 0.9)
    found = {r.id: (r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, cell).collect()}
    assert found == {i: (n[i], parts[i]) for i in n}


def test_far_clusters_do_not_meet():
    """Tight clusters: the bound on pivots drops most pairs of cells, and blocks go only to groups that have a near one."""
    r = np.random.default_rng(2)
    pivots = unit(r.normal(size=(60, 32)))
    size = np.full(60, 100)
    plan = covertree.Plan({32: pivots}, {32: 0}, np.ones(60, np.int64), np.arange(60) * 100, size, np.full(60, 0.2), 1000, float(np.sqrt(0.2)))
    near = sum(len(plan.near(k, 32)) for k in range(60))
    assert near < 0.1 * 60 * 60 and all(k in plan.near(k, 32) for k in range(60))
    assert sum(len(plan.groups_near(k, 32)) for k in range(60)) < 60 * 6 / 2


@pytest.mark.parametrize("pivots", [3, 100])
def test_pivots_and_groups_bounded_by_bytes(spark, monkeypatch, pivots):
    monkeypatch.setattr(covertree, "PIVOT_BYTES", 8 * 6 * pivots)
    monkeypatch.setattr(covertree, "LEAST_GROUP", 40)
    monkeypatch.setattr(covertree, "GROUP_BYTES", 8 * 6 * 50)
    p = np.concatenate([clustered(8, 250, 6, 0.1), unit(np.ones((90, 6)) + np.random.default_rng(1).normal(size=(90, 6)) * 0.01)])
    rows = [(i, v.tolist()) for i, v in enumerate(p)]
    n, parts = brute(rows, 0.9)
    found = {r.id: (r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, 8).collect()}
    assert found == {i: (n[i], parts[i]) for i in n}


def work(spark, n, clusters, cell, seed=3):
    """Products of the sizes of near cells, for vectors in clusters, and the largest cell."""
    r = np.random.default_rng(seed)
    centres = unit(r.normal(size=(clusters, 32)))
    v = unit(centres[r.integers(0, clusters, n)] + r.normal(size=(n, 32)) * 0.02)
    rows = pa.table({"dim": pa.array(np.full(n, 32, np.int32)), "node": pa.array(np.arange(n)), "copies": pa.array(np.ones(n, np.int64)), "vector": pa.array(v.tolist())})
    plan, _ = covertree._planned(spark.createDataFrame(rows), n, float(np.sqrt(0.2)), cell)
    return sum(int(plan.size[k] * plan.size[plan.near(k, 32)].sum()) for k in range(len(plan.size)) if plan.size[k]), int(plan.size.max())


def test_cells_of_clustered_vectors_grow_in_number(spark):
    """Five times the clusters: as many times the cells, and so about the comparisons, not their square, which few pivots leave."""
    (small, _), (large, widest) = work(spark, 4_000, 40, 20), work(spark, 20_000, 200, 20)
    assert large < 8 * small and widest < 500
    assert work(spark, 20_000, 200, 20_000 // 64)[0] > 3 * large


def test_near_pivots_stand_together():
    r = np.random.default_rng(1)
    centres = unit(r.normal(size=(20, 16)))
    p = covertree.in_order(unit(np.repeat(centres, 30, axis=0)[r.permutation(600)] + r.normal(size=(600, 16)) * 0.02))
    of = covertree.nearest(p, centres)
    assert (np.diff(of) != 0).sum() < 100 and len(np.unique(p, axis=0)) == 600


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [2.0, 0.1])]
    found = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == len(rows)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in found}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[10] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)) and got[None] == (0, None, True)
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query(spark, sf_dir):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n, parts = brute(given, 0.9)
    assert {r.vec_id: (r.n_links, r.component_id) for r in op7_embedding_dedup(spark, sf_dir).collect()} == {i: (n[i], parts[i]) for i, _ in given}


@pytest.mark.parametrize("kind", ["even", "tail", "head", "far", "clustered"])
@pytest.mark.parametrize("strip", [500, 1 << 20])
def test_short_products_lose_nothing(monkeypatch, kind, strip):
    """Products of some coordinates and the length of the rest, radii taken in: the pairs are all there whatever the coordinates are like."""
    monkeypatch.setattr(covertree, "STRIP", strip)
    monkeypatch.setattr(covertree, "GATHERED", 200)
    r = np.random.default_rng(7)
    scale = {"tail": np.r_[np.full(60, 1e-9), np.ones(40)], "head": np.r_[np.ones(20), np.full(80, 1e-9)]}.get(kind, np.ones(100))
    p = clustered(4, 600, 100, 0.05) if kind == "clustered" else r.normal(size=(600, 100))
    p = unit(p * scale + (3 if kind == "far" else 0))
    p[300:330] = unit(p[:30] + r.normal(size=(30, 100)) * scale * 0.02)
    trees = [covertree.build(x).thinned() for x in (p[:350], p[250:], p)]
    for t in trees:
        assert all(len(x) <= covertree.THIN * len(y) for x, y in zip(t.centre, t.centre[1:])) and len(t.centre[-1]) == len(t.points)
        for k in range(t.depth):
            for node, below in enumerate(covertree._points_below(t, k)):
                assert np.linalg.norm(t.points[below] - t.points[t.centre[k][node]], axis=1).max() <= t.radius[k][node] + 1e-9
    for cosine in (0.5, 0.9, 0.999):
        assert pairs_of(trees[0], trees[1], cosine, False) == [tuple(x) for x in np.argwhere(p[:350] @ p[250:].T >= cosine).tolist()]
        assert pairs_of(trees[2], trees[2], cosine, True) == [tuple(x) for x in np.argwhere(np.triu(p @ p.T, 1) >= cosine).tolist()]


def test_vectors_without_structure_cost_a_product_each():
    """Two blocks of 4096 such vectors: 1.2 s to build one and 0.65 s to compare them before, as every level was opened and every pair had a bound of its own."""
    r = np.random.default_rng(5)
    p = unit(r.normal(size=(8192, 64)))
    p[::16] = unit(p[::16] + 0.05 * r.normal(size=(512, 64)) + p[3::16] * 0.5)
    w = np.ones(4096, np.int64)

    def spent(step):
        times = []
        for _ in range(3):
            began = time.process_time()
            out = step()
            times.append(time.process_time() - began)
        return out, min(times)

    left, built = spent(lambda: covertree.build(p[:4096]).thinned())
    right = covertree.build(p[4096:]).thinned()
    (found, *_), compared = spent(lambda: covertree.links_of(left, right, np.arange(4096), np.arange(4096, 8192), w, w, 0.9, False))
    assert found.sum() == (p[:4096] @ p[4096:].T >= 0.9).sum()
    assert built < 0.8 and compared < 0.4
