"""A small random forest in numpy: Gini splits on random thresholds of random features."""

from __future__ import annotations

import numpy as np


class Forest:
    """``trees`` bootstrapped trees; a tree is five flat arrays, so a model is a few kilobytes."""

    def __init__(self, trees: int = 40, depth: int = 9, leaf: int = 3, seed: int = 42):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        draw = np.random.default_rng(self.seed)
        tried = max(1, int(np.sqrt(x.shape[1]) + 1))
        for _ in range(self.trees):
            rows = draw.integers(0, len(x), len(x))
            feature, cut, low, high, value = [], [], [], [], []

            def grow(rows: np.ndarray, depth: int) -> int:
                at, mean = len(value), float(y[rows].mean())
                for column, new in ((feature, -1), (cut, 0.0), (low, 0), (high, 0), (value, mean)):
                    column.append(new)
                if depth == 0 or len(rows) < 2 * self.leaf or mean in (0.0, 1.0):
                    return at
                best = (mean * (1 - mean) - 1e-9, None, 0.0)
                for f in draw.choice(x.shape[1], tried, replace=False):
                    values = x[rows, f]
                    for t in np.unique(draw.choice(values, 12)):
                        left = values <= t
                        n = int(left.sum())
                        if n < self.leaf or len(rows) - n < self.leaf:
                            continue
                        a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                        impurity = (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                        if impurity < best[0]:
                            best = (impurity, f, float(t))
                if best[1] is None:
                    return at
                feature[at], cut[at] = int(best[1]), best[2]
                left = x[rows, best[1]] <= best[2]
                low[at] = grow(rows[left], depth - 1)
                high[at] = grow(rows[~left], depth - 1)
                return at

            grow(rows, self.depth)
            self.nodes.append(tuple(np.array(c) for c in (feature, cut, low, high, value)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees."""
        out = np.zeros(len(x))
        for feature, cut, low, high, value in self.nodes:
            at = np.zeros(len(x), dtype="i8")
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                go_low = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(go_low, low[at], high[at]), at)
            out += value[at]
        return out / max(len(self.nodes), 1)
