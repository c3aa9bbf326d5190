"""Small models: logistic regression (also from sums over parts of the rows), boosted trees, Platt scaling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Logistic:
    """L2-regularized logistic regression on standardized features, by Newton's method."""

    l2: float = 1.0
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 25) -> Logistic:
        return self.fit_sums(lambda f: f(x, y), steps)

    def fit_sums(self, add: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray], steps: int = 25) -> Logistic:
        """``add(f)`` gives the sum of ``f(x, y)``, a vector, over all parts of the rows."""
        n, *total = add(lambda x, y: np.r_[len(x), x.sum(0)])
        mean = np.array(total) / n
        scale = np.sqrt(add(lambda x, y: ((x - mean) ** 2).sum(0)) / n) + 1e-9
        w, ridge = np.zeros(len(mean) + 1), np.r_[np.full(len(mean), self.l2), 1e-6]

        def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.c_[(x - mean) / scale, np.ones(len(x))]
            p = sigmoid(z @ w)
            return np.r_[z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]

        for _ in range(steps):
            sums = add(slopes)
            step = np.linalg.solve(sums[len(w) :].reshape(len(w), -1) + np.diag(ridge), sums[: len(w)] + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.mean, self.scale, self.weights = mean, scale, w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1])


@dataclass
class BoostedTrees:
    """Gradient-boosted trees for a 0/1 target: logistic loss, second-order leaves, splits on bins."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    l2: float = 1.0
    least: int = 8
    columns: float = 1.0  # share of the features that a tree may split on, drawn anew for each
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        inner = np.linspace(0, 1, self.bins + 1)[1:-1]  # edges by rank and by value: a gap between classes has edges inside
        self.edges = [np.unique(np.r_[np.quantile(c, inner), c.min() + inner * (c.max() - c.min())]) for c in x.T]
        b, share = self._binned(x), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base, self.grown = float(np.log(share / (1 - share))), []
        score, rng = np.full(len(y), self.base), np.random.default_rng(3)
        for _ in range(self.trees):
            p = sigmoid(score)
            drawn = rng.choice(b.shape[1], max(1, round(self.columns * b.shape[1])), replace=False)
            tree = self._grow(b, p - y, p * (1 - p), sorted(drawn.tolist()))
            self.grown.append(tree)
            score += self._leaf(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, columns: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full binary tree in arrays: feature (-1 in a leaf), bin (right if above), value."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        rows = {0: np.arange(len(g))}
        for node in range(nodes):
            if (r := rows.pop(node, None)) is None or not len(r):
                continue
            gs, hs = g[r].sum(), h[r].sum()
            value[node] = -self.rate * gs / (hs + self.l2)
            if 2 * node + 2 >= nodes or len(r) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for k in columns:
                width = len(self.edges[k]) + 1
                gl, hl, n = (np.cumsum(np.bincount(b[r, k], w, width))[:-1] for w in (g[r], h[r], None))
                if not len(gl):
                    continue
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                gain[(n < self.least) | (len(r) - n < self.least)] = 0
                if (at := int(gain.argmax())) >= 0 and gain[at] > best[0]:
                    best = (gain[at], k, at)
            if best[1] >= 0:
                _, feature[node], cut[node] = best
                right = b[r, best[1]] > best[2]
                rows[2 * node + 1], rows[2 * node + 2] = r[~right], r[right]
        return feature, cut, value

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, every = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (b[every, np.maximum(f, 0)] > cut[at]))
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._leaf(t, b) for t in self.grown), np.zeros(len(x)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The acceptance threshold with the best F1."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum() + 1e-9)
    at = int(f1.argmax())
    return float((p[order][at] + p[order][min(at + 1, len(p) - 1)]) / 2)
