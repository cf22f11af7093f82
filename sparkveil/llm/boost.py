"""A small gradient-boosted tree learner: logistic loss, full binary trees, Platt calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 24, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias, self.platt = 0.0, (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        level = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.bias)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                mine = node == k
                if mine.sum() >= 8:
                    best = self._split(level[mine], g[mine], h[mine], cuts)
                    if best:
                        feature[k], cut[k] = best
                node[mine] = 2 * k + 1 + (x[mine, feature[k]] > cut[k])
            leaf = node - inner
            n = inner + 1
            value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.ridge)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def _split(self, level: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float] | None:
        top, found = 1e-6, None
        all_g, all_h = g.sum(), h.sum()
        base = all_g**2 / (all_h + self.ridge)
        for j, c in enumerate(cuts):
            if len(c):
                lg, lh = (np.cumsum(np.bincount(level[:, j], v, len(c) + 1))[:-1] for v in (g, h))
                gain = lg**2 / (lh + self.ridge) + (all_g - lg) ** 2 / (all_h - lh + self.ridge) - base
                k = int(np.argmax(gain))
                if gain[k] > top:
                    top, found = gain[k], (j, float(c[k]))
        return found

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            f += value[node - len(feature)]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows that the trees have not seen."""
        m = self.margin(x)
        at = np.array([1.0, 0.0])

        def loss(v: np.ndarray) -> float:
            z = v[0] * m + v[1]
            return float(np.logaddexp(0, z).sum() - (y * z).sum() + ((v[0] - 1) ** 2 + v[1] ** 2) / 2)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(at[0] * m + at[1], -30, 30)))
            w = p * (1 - p)
            hessian = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
            step = np.linalg.solve(hessian, [((p - y) * m).sum() + at[0] - 1, (p - y).sum() + at[1]])
            # a Newton step is halved until it lowers the loss
            while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
                step = step / 2
            at = at - step
        a, b = at
        self.platt = (float(a), float(b))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * self.margin(x) + self.platt[1], -30, 30)))
