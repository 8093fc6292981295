"""Gradient-boosted regression trees for two classes, on numpy: binned features, second-order splits."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.25, l2: float = 1.0, least: float = 2.0, part: float = 0.5):
        self.n, self.depth, self.bins, self.rate, self.l2, self.least, self.part = trees, depth, bins, rate, l2, least, part

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rows, cols = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(cols)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)])
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(rows, self.base)
        width = self.bins + 1
        flat = binned + np.arange(cols) * width
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((self.n, size), np.int32)
        self.value = np.full((self.n, size), np.inf, np.float32)  # go left where x <= value
        self.leaf = np.zeros((self.n, size), np.float32)
        pick = np.random.default_rng(0)
        for t in range(self.n):
            # a tree is grown on a part of the rows, drawn anew (stochastic boosting), and scores all
            own = np.flatnonzero(pick.random(rows) < self.part)
            p = 1 / (1 + np.exp(-score[own]))
            g, h = p - y[own], p * (1 - p)
            at, flat_own, x_own = np.zeros(len(own), np.int64), flat[own], x[own]
            for d in range(self.depth):
                first, many = 2**d - 1, 2**d
                key = ((at - first)[:, None] * (cols * width) + flat_own).ravel()
                gs = np.bincount(key, np.repeat(g, cols), many * cols * width).reshape(many, cols, width)
                hs = np.bincount(key, np.repeat(h, cols), many * cols * width).reshape(many, cols, width)
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                best = gain.reshape(many, -1).argmax(1)
                for k in range(many):
                    j, b = divmod(int(best[k]), width)
                    if gain[k, j, b] > 1e-6 and b < len(self.cuts[j]):
                        self.feature[t, first + k], self.value[t, first + k] = j, self.cuts[j][b]
                f, v = self.feature[t, at], self.value[t, at]
                at = 2 * at + 1 + (x_own[np.arange(len(own)), f] > v)
            total_g, total_h = np.bincount(at, g, size), np.bincount(at, h, size)
            self.leaf[t] = -self.rate * total_g / (total_h + self.l2)
            score += self.leaf[t, self._leaves(t, x)]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in range(self.n):
            out += self.leaf[t, self._leaves(t, x)]
        return out

    def _leaves(self, t: int, x: np.ndarray) -> np.ndarray:
        rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.value[t, at])
        return at
