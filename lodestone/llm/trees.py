"""Gradient-boosted regression trees for two classes, in numpy over binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic boosting with trees of a fixed depth; a tree is a full binary heap of (feature, bin) splits."""

    depth: int = 4
    rate: float = 0.2
    n_trees: int = 80
    bins: int = 32
    cuts: list[np.ndarray] = field(default_factory=list)
    features: np.ndarray | None = None
    splits: np.ndarray | None = None
    leaves: np.ndarray | None = None
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        codes = self._binned(x)
        n, m = codes.shape
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, self.base)
        inner, width = 2**self.depth - 1, self.bins + 1
        self.features, self.splits = np.zeros((self.n_trees, inner), np.int64), np.full((self.n_trees, inner), width)
        self.leaves = np.zeros((self.n_trees, 2**self.depth))
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-9)
                for k in range(m):
                    key = (node - first) * width + codes[:, k]
                    gs = np.bincount(key, g, many * width).reshape(many, width).cumsum(axis=1)
                    hs = np.bincount(key, h, many * width).reshape(many, width).cumsum(axis=1)
                    total_g, total_h = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    at = gain[:, :-1].argmax(axis=1)
                    value = gain[np.arange(many), at]
                    better = np.flatnonzero(value > best)
                    best[better] = value[better]
                    self.features[t, first + better] = k
                    self.splits[t, first + better] = at[better]
                node = 2 * node + 1 + (codes[np.arange(n), self.features[t, node]] > self.splits[t, node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            self.leaves[t] = self.rate * gs / (hs + 1)
            f += self.leaves[t][leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        codes = self._binned(x)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (codes[rows, self.features[t, node]] > self.splits[t, node])
            out += self.leaves[t][node - (2**self.depth - 1)]
        return out
