"""Gradient-boosted trees for a binary label, on binned features, with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1: leaf
    cut: np.ndarray
    left: np.ndarray  # the right child is the next one
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while len(inner := np.flatnonzero(self.feature[at] >= 0)):
            k = at[inner]
            at[inner] = self.left[k] + (x[inner, self.feature[k]] > self.cut[k])
        return self.value[at]


@dataclass
class BoostedTrees:
    base: float
    trees: list[Tree]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, least: int = 10, ridge: float = 1.0) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(p0 / (1 - p0)))
        f, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, left, value = [-1], [0.0], [0], [0.0]
            todo = [(0, np.arange(len(y)), 0)]
            while todo:
                k, rows, d = todo.pop()
                sg, sh = g[rows].sum(), h[rows].sum()
                value[k] = rate * sg / (sh + ridge)
                best, pick = 1e-6, None
                if d < depth and len(rows) >= 2 * least:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        code = codes[j, rows]
                        n = np.cumsum(np.bincount(code, minlength=len(c) + 1))[:-1]
                        gl = np.cumsum(np.bincount(code, g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(code, h[rows], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
                        gain[(n < least) | (len(rows) - n < least)] = 0
                        if gain.max() > best:
                            best, pick = gain.max(), (j, int(gain.argmax()))
                if pick is None:
                    continue
                j, b = pick
                feature[k], cut[k], left[k] = j, float(cuts[j][b]), len(feature)
                below = codes[j, rows] <= b
                for part in (rows[below], rows[~below]):
                    todo.append((len(feature), part, d + 1))
                    feature.append(-1)
                    cut.append(0.0)
                    left.append(0)
                    value.append(0.0)
            tree = Tree(np.array(feature), np.array(cut), np.array(left), np.array(value))
            trees.append(tree)
            f = f + tree.predict(x)
        return cls(base, trees)
