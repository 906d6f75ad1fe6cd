"""Gradient-boosted decision trees for two classes, on quantised features, in NumPy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, complete trees of a fixed depth, splits at quantiles of the training data."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 12, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        cuts = [np.unique(np.concatenate([c, [v for v in np.unique(x[:, j])[:-1]]])) if len(np.unique(x[:, j])) <= self.bins else c for j, c in enumerate(cuts)]
        b = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
        m = int(b.max()) + 2
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node, size = np.zeros(n, dtype=int), 2 ** (self.depth + 1) - 1
            feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                at = node - first
                best = np.full(count, 1e-6)
                gs, hs = np.bincount(at, g, count), np.bincount(at, h, count)
                for j in range(d):
                    k = at * m + b[:, j]
                    gl = np.bincount(k, g, count * m).reshape(count, m).cumsum(1)[:, :-1]
                    hl = np.bincount(k, h, count * m).reshape(count, m).cumsum(1)[:, :-1]
                    gain = gl**2 / (hl + self.l2) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + self.l2) - (gs**2 / (hs + self.l2))[:, None]
                    for q, c in enumerate(gain.argmax(1)):
                        if gain[q, c] > best[q] and c < len(cuts[j]):
                            best[q] = gain[q, c]
                            feature[first + q], cut[first + q] = j, cuts[j][c]
                right = np.zeros(n, dtype=bool)
                split = feature[node] >= 0
                right[split] = x[split, feature[node[split]]] > cut[node[split]]
                node = 2 * node + 1 + right
            gl, hl = np.bincount(node, g, size), np.bincount(node, h, size)
            leaf = self.rate * gl / (hl + self.l2)
            self.trees.append((feature, cut, leaf))
            f = f + leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                j = feature[node]
                node = 2 * node + 1 + np.where(j >= 0, x[rows, np.maximum(j, 0)] > cut[node], False)
            f += leaf[node]
        return f
