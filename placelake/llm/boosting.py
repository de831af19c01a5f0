"""Gradient-boosted trees over a bounded sample, and the calibration of what they say."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of one depth for a log-odds, fitted by second-order steps over binned features; deterministic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: float = 2.0, decay: float = 1.0):
        self.depth, self.features, self.cuts, self.values = depth, [], [], []
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)] if n else []
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), np.int64)
        share = (y.sum() + 1) / (n + 2)
        self.start = float(np.log(share / (1 - share)))
        raw = np.full(n, self.start)
        for _ in range(trees if n else 0):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            leaf = np.zeros(n, np.int64)
            for level in range(depth):
                first, size = 2**level - 1, 2**level
                gain, split = np.full(size, 1e-6), {}
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = leaf * (BINS + 1) + binned[:, f]
                    left = [np.cumsum(np.bincount(key, w, size * (BINS + 1)).reshape(size, -1), axis=1) for w in (g, h)]
                    all_g, all_h = left[0][:, -1:], left[1][:, -1:]
                    here = left[0] ** 2 / (left[1] + decay) + (all_g - left[0]) ** 2 / (all_h - left[1] + decay) - all_g**2 / (all_h + decay)
                    here = np.where((left[1] >= least / 4) & (all_h - left[1] >= least / 4), here, 0)[:, : len(e)]
                    best = here.argmax(axis=1)
                    for node in np.flatnonzero(here.max(axis=1) > gain).tolist():
                        gain[node], split[node] = here[node, best[node]], (f, int(best[node]))
                go = np.zeros(n, np.int64)
                for node, (f, b) in split.items():
                    feature[first + node], cut[first + node] = f, edges[f][b]
                    at = leaf == node
                    go[at] = binned[at, f] > b
                leaf = 2 * leaf + go
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + decay)
            raw += value[leaf]
            self.features.append(feature)
            self.cuts.append(cut)
            self.values.append(value)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[node]] > cut[node])
            out += value[leaf]
        return out


class Calibration:
    """Probabilities by a line through the log-odds, fitted on rows that the trees haven't seen."""

    def __init__(self, raw: np.ndarray, y: np.ndarray):
        self.slope, self.offset = 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50 if len(np.unique(y)) == 2 else 0):
            p = self(raw)
            w = p * (1 - p) + 1e-9
            gradient = np.array([((p - target) * raw).sum(), (p - target).sum()])
            matrix = np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(matrix, gradient)
            self.slope, self.offset = max(0.05, self.slope - step[0]), self.offset - step[1]

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -60, 60)))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability, of 0.5 at least, from which on ``precision`` of the rows are right; over 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.ones(len(p), bool)
    last[:-1] = p[order][:-1] != p[order][1:]  # rows of equal probability stand or fall together
    good = np.flatnonzero((right >= precision) & last & (p[order] >= 0.5))
    if not len(good):
        return 1.01
    after = p[order][good[-1] + 1] if good[-1] + 1 < len(p) else 0.0
    return float(max(0.5, (p[order][good[-1]] + after) / 2))
