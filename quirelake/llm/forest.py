"""A small random forest for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            rows = np.flatnonzero(inner)
            go = x[rows, f[rows]] <= self.cut[at[rows]]
            at[rows] = np.where(go, self.left[at[rows]], self.right[at[rows]])


def _best_cut(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """Weighted Gini impurity, feature and cut of the best split."""
    best, n = None, len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= least) & (n - k >= least)]
        if not len(k):
            continue
        a, b = ones[k - 1], ones[-1] - ones[k - 1]
        gini = a * (k - a) / k + b * (n - k - b) / (n - k)
        i = int(gini.argmin())
        if best is None or gini[i] < best[0]:
            low, high = float(v[k[i] - 1]), float(v[k[i]])
            middle = (low + high) / 2
            best = (float(gini[i]), int(f), middle if low <= middle < high else low)  # between neighbours the middle may round up
    return best


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> Tree:
    feature, cut, left, right, value = [], [], [], [], []
    tried = max(1, int(np.sqrt(x.shape[1]) + 1))

    def node(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, float(y[rows].mean()))):
            a.append(v)
        if level < depth and 0 < value[me] < 1:
            found = _best_cut(x[rows], y[rows], rng.permutation(x.shape[1])[:tried], least)
            if found:
                _, feature[me], cut[me] = found
                go = x[rows, feature[me]] <= cut[me]
                left[me], right[me] = node(rows[go], level + 1), node(rows[~go], level + 1)
        return me

    node(np.arange(len(y)), 0)
    return Tree(*map(np.array, (feature, cut, left, right, value)))


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of the positive class in the leaves."""
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 31, depth: int = 12, least: int = 2, seed: int = 11) -> Forest:
    """Trees on bootstrap samples, each split over a random subset of the features; the same rows and seed give the same forest."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, float)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], rng, depth, least))
    return Forest(tuple(out))
