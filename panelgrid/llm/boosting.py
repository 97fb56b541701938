"""Gradient-boosted trees on logistic loss, small and in NumPy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Newton boosting with trees of a fixed depth, each level splitting by the best threshold of each node."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, value = self._tree(x, p - y, p * (1 - p), cuts)
            self.trees.append(tree)
            margin += value
        return self

    def _tree(self, x, g, h, cuts):
        """A complete binary tree: feature and threshold of inner nodes, values of leaves."""
        inner = 2**self.depth - 1
        feature, threshold, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**self.depth)
        node = np.zeros(len(g), int)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            if len(rows) >= 2 * self.least:
                best, gk, hk = 1e-6, g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    left = x[rows, f][:, None] <= c
                    n, gl, hl = left.sum(0), g[rows] @ left, h[rows] @ left
                    gain = gl**2 / (hl + self.ridge) + (gk - gl) ** 2 / (hk - hl + self.ridge) - gk**2 / (hk + self.ridge)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                    if len(c) and gain.max() > best:
                        best, feature[k], threshold[k] = gain.max(), f, c[gain.argmax()]
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
        at = node - inner
        for k in range(len(leaf)):
            rows = at == k
            leaf[k] = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
        return (feature, threshold, leaf), leaf[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))
