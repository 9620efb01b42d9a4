"""Gradient-boosted trees for binary labels on a bounded training set, with Platt calibration.

The training rows are few (callers bound and document their number), so fitting runs on the driver with histograms;
the fitted trees are small arrays that go to the executors and score batches of rows.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 4.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.nodes: list[list[tuple[int, float, float]]] = []
        self.start, self.a, self.b = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            tree, at = self._grow(binned, cuts, g, h)
            self.nodes.append(tree)
            margin += np.array([n[2] for n in tree])[at]
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, float, float]], np.ndarray]:
        """Nodes in heap order as (feature or -1, cut, value), and the leaf of every row."""
        size = 2 ** (self.depth + 1) - 1
        tree = [(-1, 0.0, 0.0)] * size
        at = np.zeros(len(g), dtype=int)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            best, split = 1e-6, None
            if node < 2**self.depth - 1:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], minlength=len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], minlength=len(c) + 1))[:-1]
                    n = np.cumsum(np.bincount(binned[rows, f], minlength=len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + self.l2) + (gs - left_g) ** 2 / (hs - left_h + self.l2) - gs**2 / (hs + self.l2)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, split = float(gain[k]), (f, k)
            if split is None:
                tree[node] = (-1, 0.0, float(-self.rate * gs / (hs + self.l2)))
            else:
                f, k = split
                tree[node] = (f, float(cuts[f][k]), 0.0)
                at[rows] = np.where(binned[rows, f] <= k, 2 * node + 1, 2 * node + 2)
        return tree, at

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        columns = np.ascontiguousarray(x.T)
        out = np.full(len(x), self.start)

        def value(tree: list[tuple[int, float, float]], node: int) -> np.ndarray | float:
            f, cut, leaf = tree[node]
            return leaf if f < 0 else np.where(columns[f] > cut, value(tree, 2 * node + 2), value(tree, 2 * node + 1))

        for tree in self.nodes:
            out += value(tree, 0)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Platt scaling on rows kept aside: a slope and an offset for the margin, targets drawn in from 0 and 1."""
        m, y = self.margin(x), np.asarray(y, dtype=float)
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
            if abs(step).max() < 1e-8:
                break
        self.a, self.b = max(a, 0.05), b
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))
