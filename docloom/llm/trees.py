"""Gradient-boosted trees on a bounded training matrix, kept as flat numpy node arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth: node k of a tree has the children 2 k + 1 and 2 k + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; larger values go right
    value: np.ndarray  # trees x leaves
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least: int = 8, monotone: dict[int, int] | None = None) -> Forest:
    """Logistic boosting by histograms. monotone: for a feature +1 (never falls) or -1 (never rises).

    A split on such a feature counts only if its sides' values are ordered; the mean of the two then bounds all that
    lies below on either side, so the whole forest is monotone. With one class or no rows it is a constant.
    """
    monotone = monotone or {}
    n, m = x.shape
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    out = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    if n == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 2, -np.inf), np.full(2 * inner + 2, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, choice = np.full(width, 1e-6), np.full((width, 2), -1)
            sides = np.zeros((width, 2))
            at = node - first
            total = [np.bincount(at, w, width) for w in (g, h, np.ones(n))]
            for j in range(m):
                k = len(edges[j]) + 1
                if k == 1:
                    continue
                key = at * k + binned[:, j]
                gl, hl, nl = (np.bincount(key, w, width * k).reshape(width, k).cumsum(axis=1)[:, :-1] for w in (g, h, np.ones(n)))
                gr, hr, nr = (t[:, None] - c for t, c in zip(total, (gl, hl, nl), strict=True))
                vl, vr = gl / (hl + ridge), gr / (hr + ridge)
                gain = gl * vl + gr * vr - (total[0] ** 2 / (total[1] + ridge))[:, None]
                gain[(nl < least) | (nr < least)] = -1
                if j in monotone:
                    gain[(vr - vl) * monotone[j] < 0] = -1
                top = gain.argmax(axis=1)
                won = gain[np.arange(width), top]
                better = won > best
                best[better] = won[better]
                choice[better, 0], choice[better, 1] = j, top[better]
                sides[better] = np.stack([vl, vr], axis=2)[np.arange(width), top][better]
            right = np.zeros(n, dtype=np.int64)
            for w in range(width):
                k = first + w
                low[[2 * k + 1, 2 * k + 2]], high[[2 * k + 1, 2 * k + 2]] = low[k], high[k]
                j, b = choice[w]
                if j < 0:
                    continue
                feature[k], threshold[k] = j, edges[j][b]
                if j in monotone:
                    middle = float(np.clip(sides[w].mean(), low[k], high[k]))
                    up, down = (2 * k + 2, 2 * k + 1) if monotone[j] > 0 else (2 * k + 1, 2 * k + 2)
                    low[up], high[down] = max(low[up], middle), min(high[down], middle)
                here = at == w
                right[here] = binned[here, j] > b
            node = 2 * node + 1 + right
        leaf = node - inner
        value = np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        value = rate * np.clip(value, low[inner : inner + leaves], high[inner : inner + leaves])
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base, depth)
