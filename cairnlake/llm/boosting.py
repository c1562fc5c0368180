"""Gradient-boosted trees for binary labels, trained on a bounded sample, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete binary tree of fixed depth in arrays: inner nodes ask ``x[feature] > cut``."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, inner, rows = np.zeros(len(x), np.int64), len(self.feature), np.arange(len(x))
        while inner and at.min(initial=inner) < inner:
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.leaf[at - inner]


@dataclass
class BoostedTrees:
    """Logistic boosting on quantile bins; ``calibrate`` fits a slope and an offset on held-out labels."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    least: float = 4.0
    base: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        """Trees on ``x`` (rows by features) for labels 0 and 1."""
        w = np.ones(len(y)) if weight is None else weight
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
        p = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, cuts, w * (prob - y), w * prob * (1 - prob))
            self.trees.append(tree)
            score += tree.predict(x)
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node, wide = np.zeros(len(g), np.int64), self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            best, found = np.full(count, 1e-6), [None] * count
            for f in range(binned.shape[1]):
                key = (node - first) * wide + binned[:, f]
                gs = np.bincount(key, g, count * wide).reshape(count, wide).cumsum(1)
                hs = np.bincount(key, h, count * wide).reshape(count, wide).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                gain = gain[:, : len(cuts[f])]
                if gain.shape[1]:
                    at = gain.argmax(1)
                    value = gain[np.arange(count), at]
                    for k in np.flatnonzero(value > best):
                        best[k], found[k] = value[k], (f, at[k])
            for k, split in enumerate(found):
                if split:
                    feature[first + k], cut[first + k] = split[0], cuts[split[0]][split[1]]
            right = binned[np.arange(len(node)), feature[node]]
            limit = np.array([found[k][1] if found[k] else wide for k in range(count)])[node - first]
            node = 2 * node + 1 + (right > limit)
        leaves = 2**self.depth
        gs, hs = np.bincount(node - inner, g, leaves), np.bincount(node - inner, h, leaves)
        return Tree(feature, cut, -self.rate * gs / (hs + 1))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling: damped Newton steps on the logistic loss with smoothed targets and a pull towards slope 1 and offset 0."""
        m = self.margin(x)
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

        def loss(v: np.ndarray) -> float:
            z = v[0] * m + v[1]
            return float((np.logaddexp(0, z) - t * z).sum() + 2 * (v[0] - 1) ** 2 + 2 * v[1] ** 2)

        v = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(v[0] * m + v[1], -40, 40)))
            r, w = p - t, p * (1 - p)
            grad = np.array([(r * m).sum() + 4 * (v[0] - 1), r.sum() + 4 * v[1]])
            hess = np.array([[(w * m * m).sum() + 4, (w * m).sum()], [(w * m).sum(), w.sum() + 4]])
            step, scale = np.linalg.solve(hess, grad), 1.0
            while scale > 1e-6 and loss(v - scale * step) > loss(v):
                scale /= 2
            v = v - scale * step
            if np.abs(scale * step).max() < 1e-9:
                break
        self.slope, self.offset = float(v[0]), float(v[1])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -40, 40)))
