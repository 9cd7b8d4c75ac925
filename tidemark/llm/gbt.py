"""Histogram gradient-boosted trees for two classes, kept as flat arrays.

``fit`` bins every feature by quantiles and grows level by level from histograms of gradients and hessians. The model is
five flat arrays over the nodes of all trees; ``Trees.score`` walks every row through every tree at once, one numpy step
a level. The trees are small enough to travel in a task's closure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Node arrays of all trees; a leaf points to itself. ``roots`` has the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            down = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(down, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cut points halfway between neighbouring quantiles."""
    q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
    return (q[1:] + q[:-1]) / 2


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 40,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    least_hessian: float = 2.0,
    ridge: float = 1.0,
) -> Trees:
    """Fit by Newton boosting of the logistic loss. No rows, or rows of one class, give a constant score."""
    x = np.asarray(x, np.float64)
    y = np.asarray(y, np.float64)
    rate_1 = np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98)
    base = float(np.log(rate_1 / (1 - rate_1)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    n, width = x.shape if len(y) else (0, 0)
    edges = [_edges(x[:, j], bins) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if width else x
    margin = np.full(n, base)

    def leaf(v: float) -> int:
        k = len(value)
        feature.append(0)
        threshold.append(0.0)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    for _ in range(trees if width and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(leaf(0.0))
        level, at = [roots[-1]], np.zeros(n, np.int64)  # at: the place of each row's node in level, or -1
        node = np.full(n, roots[-1])
        for step in range(depth + 1):
            live = at >= 0
            sums_g = np.bincount(at[live], g[live], len(level))
            sums_h = np.bincount(at[live], h[live], len(level))
            for k, nd in enumerate(level):
                value[nd] = rate * sums_g[k] / (sums_h[k] + ridge)
            if step == depth:
                break
            best = np.full(len(level), 1e-6)
            pick = np.zeros((len(level), 2), np.int64)
            for j in range(width):
                b = len(edges[j]) + 1
                key = at[live] * b + binned[live, j]
                hg = np.bincount(key, g[live], len(level) * b).reshape(-1, b).cumsum(1)[:, :-1]
                hh = np.bincount(key, h[live], len(level) * b).reshape(-1, b).cumsum(1)[:, :-1]
                if not hg.shape[1]:
                    continue
                rg, rh = sums_g[:, None] - hg, sums_h[:, None] - hh
                gain = hg**2 / (hh + ridge) + rg**2 / (rh + ridge) - (sums_g**2 / (sums_h + ridge))[:, None]
                gain[(hh < least_hessian) | (rh < least_hessian)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(len(level)), top] > best
                best[better] = gain[np.arange(len(level)), top][better]
                pick[better] = np.stack([np.full(better.sum(), j), top[better]], 1)
            below, to = [], np.full((len(level), 2), -1)
            for k, nd in enumerate(level):
                if best[k] > 1e-6:
                    feature[nd], threshold[nd] = int(pick[k, 0]), float(edges[pick[k, 0]][pick[k, 1]])
                    left[nd], right[nd] = leaf(0.0), leaf(0.0)
                    to[k] = len(below), len(below) + 1
                    below += [left[nd], right[nd]]
            if not below:
                break
            f = np.array([feature[nd] for nd in level])
            cutoff = np.array([threshold[nd] for nd in level])
            goes = (x[np.arange(n), f[at]] > cutoff[at]).astype(int)
            at = np.where(live, to[at, goes], -1)
            node = np.where(at >= 0, np.array(below)[at], node)
            level = below
        margin += np.array(value)[node]
    return Trees(
        *(np.array(a, t) for a, t in zip((feature, threshold, left, right, value, roots), (int, float, int, int, float, int))),
        depth,
        base,
    )
