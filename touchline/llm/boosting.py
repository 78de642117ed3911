"""Histogram gradient-boosted trees on numpy arrays, flattened for vectorised traversal.

Features are cut into at most `BINS` quantile bins. Each tree is grown level by level to a
complete binary tree of `depth` levels from histograms of gradients per (node, bin), so a
model is three arrays: feature and threshold of each inner node and the value of each leaf.
A batch of rows walks all trees at once, one comparison per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray    # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same; a row goes right when its value is greater
    leaf: np.ndarray       # (trees, 2**depth)
    base: float            # log odds before any tree

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row of a (rows, features) array."""
        n, trees = len(rows), np.arange(len(self.feature))
        node = np.zeros((n, len(trees)), dtype=np.int32)
        which = np.arange(n)[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(trees) else 0):
            right = rows[which, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        leaf = node - self.feature.shape[1]
        return self.base + self.leaf[trees, leaf].sum(axis=1) if len(trees) else np.full(n, self.base)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def _edges(column: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))


def train(
    rows: np.ndarray, labels: np.ndarray, trees: int = 100, depth: int = 4,
    rate: float = 0.15, ridge: float = 2.0, least: float = 4.0,
) -> Trees:
    """Logistic loss. With no rows the model says 0.5; with one class it says that class."""
    inner = 2 ** depth - 1
    n = len(rows)
    share = (labels.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    features = rows.shape[1]
    if not n or labels.min() == labels.max():
        empty = np.zeros((0, inner))
        return Trees(empty.astype(np.int32), empty, np.zeros((0, inner + 1)), base)

    edges = [_edges(rows[:, f]) for f in range(features)]
    bins = np.stack([np.searchsorted(edges[f], rows[:, f]) for f in range(features)], axis=1).astype(np.int64)
    margin = np.full(n, base)
    model = Trees(np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-9)
            for f in range(features):
                if not len(edges[f]):
                    continue
                cell = (node - first) * BINS + bins[:, f]
                g = np.bincount(cell, gradient, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(cell, weight, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gl, hl = g[:, : len(edges[f])], h[:, : len(edges[f])]
                gr, hr = g[:, -1:] - gl, h[:, -1:] - hl
                gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(hl < least / 4) | (hr < least / 4)] = 0
                cut = gain.argmax(axis=1)
                found = gain[np.arange(width), cut]
                better = found > best
                best[better] = found[better]
                at = first + np.flatnonzero(better)
                model.feature[t, at] = f
                model.threshold[t, at] = edges[f][cut[better]]
            right = rows[np.arange(n), model.feature[t, node]] > model.threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, weight, inner + 1)
        model.leaf[t] = rate * g / (h + ridge)
        margin += model.leaf[t][leaf]
    return model
