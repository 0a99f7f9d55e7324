"""Gradient-boosted trees for two classes in numpy: quantile bins, level-wise trees, Newton leaf values."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    def __init__(self, rounds: int = 50, depth: int = 4, rate: float = 0.25, least: float = 3.0, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.least, self.smooth = rounds, depth, rate, least, smooth
        self.cuts: list[np.ndarray] = []
        self.features = self.thresholds = self.leaves = self.odds = np.zeros(0)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b, n_f = self.binned(x), x.shape[1]
        inner, z = (1 << self.depth) - 1, np.zeros(len(y))
        self.features = np.zeros((self.rounds, inner), dtype=np.int64)
        self.thresholds = np.full((self.rounds, inner), BINS, dtype=np.int16)  # all go left where nothing splits
        self.leaves = np.zeros((self.rounds, 1 << self.depth))
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p) + 1e-6
            node = np.zeros(len(y), dtype=np.int64)
            for d in range(self.depth):
                wide, first = 1 << d, (1 << d) - 1
                best = np.zeros(wide)
                for f in range(n_f):
                    at = node * BINS + b[:, f]
                    gs = np.bincount(at, g, wide * BINS).reshape(wide, BINS).cumsum(1)
                    hs = np.bincount(at, h, wide * BINS).reshape(wide, BINS).cumsum(1)
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    gain = gs**2 / (hs + self.smooth) + gr**2 / (hr + self.smooth) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.smooth)
                    gain[(hs < self.least) | (hr < self.least)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(wide), k]
                    for w in np.flatnonzero(top > best + 1e-9):
                        best[w] = top[w]
                        self.features[t, first + w], self.thresholds[t, first + w] = f, k[w]
                node = node * 2 + (b[np.arange(len(y)), self.features[t, first + node]] > self.thresholds[t, first + node])
            gs, hs = np.bincount(node, g, 1 << self.depth), np.bincount(node, h, 1 << self.depth)
            self.leaves[t] = -self.rate * gs / (hs + self.smooth)
            z += self.leaves[t][node]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        z, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(self.rounds):
            node = np.zeros(len(x), dtype=np.int64)
            for d in range(self.depth):
                at = (1 << d) - 1 + node
                node = node * 2 + (b[rows, self.features[t, at]] > self.thresholds[t, at])
            z += self.leaves[t][node]
        return z
