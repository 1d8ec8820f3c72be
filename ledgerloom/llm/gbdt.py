"""Gradient-boosted trees for two classes, in numpy, with calibrated scores.

All nodes of one level of a tree test the same feature at the same cut, so a row's leaf is a number of ``depth`` bits
and a tree is scored by ``depth`` comparisons of whole columns.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of symmetric trees. A level looks for its cut among ``share`` of the features and of the rows, drawn from one seed, so a fit is repeatable."""

    def __init__(self, trees: int = 70, depth: int = 4, rate: float = 0.25, bins: int = 24, l2: float = 1.0, least: float = 1.0, share: float = 0.4, seed: int = 5):
        self.n_trees, self.depth, self.rate, self.bins, self.l2, self.least, self.share, self.seed = trees, depth, rate, bins, l2, least, share, seed
        self.trees: list[tuple[list[int], list[float], np.ndarray]] = []
        self.base, self.slope, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = []
        for j in range(x.shape[1]):
            u = np.unique(x[:, j])
            mid = (u[1:] + u[:-1]) / 2
            edges.append(mid if len(mid) < self.bins else np.unique(np.quantile(mid, np.linspace(0, 1, self.bins))))
        width = max(len(e) for e in edges) + 1
        binned = [np.searchsorted(e, x[:, j], side="left").astype(np.int32) for j, e in enumerate(edges)]
        usable = np.array([j for j, e in enumerate(edges) if len(e)])
        if not len(usable):
            usable = np.zeros(1, dtype=np.int64)
        draw = np.random.default_rng(self.seed)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, q * (1 - q)
            leaf = np.zeros(len(y), dtype=np.int32)
            features: list[int] = []
            cuts: list[float] = []
            rows = np.sort(draw.permutation(len(y))[: max(1, int(self.share * len(y)))])
            g_some, h_some = g[rows], h[rows]
            for level in range(self.depth):
                best = (-np.inf, int(usable[0]), 0)
                base = leaf[rows] * width
                for j in np.sort(draw.permutation(usable)[: max(1, int(np.ceil(self.share * len(usable))))]).tolist():
                    if not len(edges[j]):
                        continue
                    at = base + binned[j][rows]
                    gl = np.cumsum(np.bincount(at, weights=g_some, minlength=width << level).reshape(-1, width), axis=1)
                    hl = np.cumsum(np.bincount(at, weights=h_some, minlength=width << level).reshape(-1, width), axis=1)
                    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                    gain = np.where((hl >= self.least) & (hr >= self.least), gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2), gl[:, -1:] ** 2 / (hl[:, -1:] + self.l2)).sum(axis=0)[: len(edges[j])]
                    c = int(gain.argmax())
                    if gain[c] > best[0] + 1e-9:
                        best = (float(gain[c]), j, c)
                features.append(best[1])
                cuts.append(float(edges[best[1]][best[2]]) if len(edges[best[1]]) else np.inf)
                leaf = 2 * leaf + (x[:, best[1]] > cuts[-1])
            gs, hs = np.bincount(leaf, weights=g, minlength=1 << self.depth), np.bincount(leaf, weights=h, minlength=1 << self.depth)
            value = -self.rate * gs / (hs + self.l2)
            self.trees.append((features, cuts, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        columns = np.ascontiguousarray(x.T)
        for features, cuts, value in self.trees:
            leaf = np.zeros(len(x), dtype=np.int16)
            for j, cut in zip(features, cuts):
                leaf += leaf
                leaf += columns[j] > cut
            f += value[leaf]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows that were not fitted, by Newton steps with smoothed targets."""
        f = self.margin(x)
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, c = 1.0, 0.0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * f + c, -40, 40)))
            w = q * (1 - q) + 1e-9
            r = q - t
            g = np.array([(r * f).sum(), r.sum()]) + np.array([1e-3 * (a - 1), 0])
            hess = np.array([[(w * f * f).sum() + 1e-3, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-6]])
            d = np.linalg.solve(hess, g)
            a, c = a - d[0], c - d[1]
            if np.abs(d).max() < 1e-8:
                break
        self.slope, self.shift = float(max(a, 1e-3)), float(c)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def best_threshold(p: np.ndarray, y: np.ndarray, recall_weight: float = 1.0) -> float:
    """Probability at which the F measure is highest (recall counts ``recall_weight`` times as much as precision), in the middle of the gap to the next lower score."""
    order = np.argsort(-p, kind="stable")
    tp = np.cumsum(y[order])
    w = recall_weight**2
    f1 = (1 + w) * tp / (np.arange(1, len(p) + 1) + w * y.sum())
    last = np.append(np.diff(p[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 0.05, 0.95))
