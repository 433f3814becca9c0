"""A small random forest (no Spark here): Gini splits on quantile bins, bootstrap rows, random feature subsets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            go = rows[inner]
            node = at[go]
            at[go] = np.where(x[go, self.feature[node]] <= self.cut[node], self.low[node], self.high[node])


@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the share of positives in a row's leaf."""
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, leaf: int = 3, bins: int = 32, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    return Forest([_grow(binned, y.astype(np.float64), cuts, rng.integers(0, len(x), len(x)), depth, leaf, rng) for _ in range(trees)])


def _grow(binned: np.ndarray, y: np.ndarray, cuts: list, rows: np.ndarray, depth: int, leaf: int, rng: np.random.Generator) -> Tree:
    feature, cut, low, high, value = [], [], [], [], []

    def add(rows: np.ndarray, left: int) -> int:
        me = len(feature)
        for column, start in ((feature, -1), (cut, 0.0), (low, 0), (high, 0), (value, float(y[rows].mean()))):
            column.append(start)
        found = _split(binned, y, rows, leaf, rng) if left and 0 < value[me] < 1 else None
        if found:
            f, b = found
            goes = binned[rows, f] <= b
            feature[me], cut[me] = f, float(cuts[f][b])
            low[me] = add(rows[goes], left - 1)
            high[me] = add(rows[~goes], left - 1)
        return me

    add(rows, depth)
    return Tree(np.array(feature), np.array(cut), np.array(low), np.array(high), np.array(value))


def _split(binned: np.ndarray, y: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple[int, int] | None:
    n, total, best, least = len(rows), y[rows].sum(), None, np.inf
    for f in rng.choice(binned.shape[1], max(1, int(np.sqrt(binned.shape[1]))), replace=False):
        b = binned[rows, f]
        count = np.cumsum(np.bincount(b, minlength=2))[:-1]
        ones = np.cumsum(np.bincount(b, weights=y[rows], minlength=2))[:-1]
        other = n - count
        with np.errstate(divide="ignore", invalid="ignore"):
            impure = ones - ones**2 / count + (total - ones) - (total - ones) ** 2 / other
        impure[(count < leaf) | (other < leaf)] = np.inf
        k = int(impure.argmin())
        if impure[k] < least:
            best, least = (int(f), k), impure[k]
    return best
