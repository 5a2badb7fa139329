"""Gradient-boosted trees for two classes on binned features, in numpy.

Used on a bounded training sample; the fitted trees are a few small arrays.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of one depth: at level l, node j asks ``x[feature] > cut``."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, depth, rows = np.full(len(x), self.base), int(np.log2(self.leaf.shape[1])), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (leaf.size - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; ties between splits go to the first feature and cut."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # bin > b when x > cut b
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, size = np.full(n, base), 2 ** depth
    features, limits, leaves = [], [], []
    offset = np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, c, at = np.zeros(size - 1, np.int64), np.full(size - 1, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first = 2 ** level - 1
            for node in range(first, 2 * first + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2:
                    continue
                where = (binned[rows] + offset).ravel()
                sg = np.bincount(where, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(1)
                sh = np.bincount(where, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(1)
                tg, th = g[rows].sum(), h[rows].sum()
                gain = sg ** 2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg ** 2 / (th + l2)
                gain[:, -1] = 0
                for j, own in enumerate(cuts):
                    gain[j, len(own):] = 0
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-6:
                    f[node], c[node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > c[at])
        at -= size - 1
        leaf = -rate * np.bincount(at, g, size) / (np.bincount(at, h, size) + l2)
        margin += leaf[at]
        features.append(f)
        limits.append(c)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(limits), np.array(leaves), base)
