"""Gradient-boosted trees for several classes over binned features, in NumPy; complete trees of a fixed depth."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Softmax boosting: each round adds one tree a class, fitted to gradients and curvatures."""

    def __init__(self, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.ridge, self.least = classes, rounds, depth, rate, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        score = np.zeros((len(x), self.classes))
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature = np.zeros((self.rounds, self.classes, inner), np.int64)
        self.cut = np.full((self.rounds, self.classes, inner), np.inf)
        self.value = np.zeros((self.rounds, self.classes, leaves))
        for r in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k in range(self.classes):
                g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                at = np.zeros(len(x), np.int64)
                for level in range(self.depth):
                    at = self._split(binned, g, h, at, level, r, k)
                gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
                self.value[r, k] = -self.rate * gs / (hs + self.ridge)
                score[:, k] += self.value[r, k][at]
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, level: int, r: int, k: int) -> np.ndarray:
        nodes = 1 << level
        gain, where = np.zeros(nodes), np.zeros((nodes, 2), np.int64)
        for f in range(binned.shape[1]):
            if not len(self.edges[f]):
                continue
            cell = at * BINS + binned[:, f]
            left_g = np.bincount(cell, g, nodes * BINS).reshape(nodes, BINS).cumsum(1)
            left_h = np.bincount(cell, h, nodes * BINS).reshape(nodes, BINS).cumsum(1)
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            better = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - all_g**2 / (all_h + self.ridge)
            better[(left_h < self.least) | (right_h < self.least)] = 0
            better = better[:, : len(self.edges[f])]
            best = better.argmax(1)
            higher = better[np.arange(nodes), best] > gain + 1e-9
            gain[higher] = better[np.arange(nodes), best][higher]
            where[higher] = np.stack([np.full(nodes, f), best], 1)[higher]
        go = np.zeros(len(at), np.int64)
        for n in range(nodes):
            if gain[n] > 0:
                f, b = where[n]
                self.feature[r, k, nodes - 1 + n], self.cut[r, k, nodes - 1 + n] = f, self.edges[f][b]
                here = at == n
                go[here] = binned[here, f] > b
        return at * 2 + go

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for r in range(self.rounds):
            for k in range(self.classes):
                at = np.zeros(len(x), np.int64)
                feature, cut = self.feature[r, k], self.cut[r, k]
                for level in range(self.depth):
                    node = (1 << level) - 1 + at
                    at = at * 2 + (x[rows, feature[node]] > cut[node])
                score[:, k] += self.value[r, k][at]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
