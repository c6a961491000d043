"""Gradient-boosted trees in numpy with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in one set of arrays; leaves point to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of `x`."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, smooth: float = 1.0, least: int = 10) -> Forest:
    """Logistic boosting. signs: per feature 1 (score may only rise with it), -1 (only fall) or 0.

    A split that breaks its feature's sign is not taken, and the children's values are
    kept on their sides of the middle, so the constraint holds over whole trees.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], 1) + np.arange(m) * bins
    rate_of_ones = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    margin = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new_node(v: float) -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v * rate)
        return k

    def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        g, h = gradient[rows], hessian[rows]
        node = new_node(float(np.clip(g.sum() / (h.sum() + smooth), lo, hi)))
        if level == depth or len(rows) < 2 * least:
            return node
        flat = codes[rows].ravel()
        sums = [np.bincount(flat, np.repeat(w, m), m * bins).reshape(m, bins).cumsum(1) for w in (g, h, np.ones(len(rows)))]
        gl, hl, nl = (s[:, :-1] for s in sums)
        gr, hr, nr = (s[:, -1:] - s[:, :-1] for s in sums)
        vl, vr = np.clip(gl / (hl + smooth), lo, hi), np.clip(gr / (hr + smooth), lo, hi)
        gain = (2 * gl * vl - (hl + smooth) * vl**2) + (2 * gr * vr - (hr + smooth) * vr**2)
        ok = (nl >= least) & (nr >= least) & (signs[:, None] * (vr - vl) >= 0)
        gain = np.where(ok, gain, -np.inf)
        f, b = divmod(int(gain.argmax()), bins - 1)
        whole = g.sum() ** 2 / (h.sum() + smooth)
        if b >= len(edges[f]) or not gain[f, b] > whole + 1e-6:
            return node
        middle = (vl[f, b] + vr[f, b]) / 2
        bounds = {1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle)), 0: ((lo, hi), (lo, hi))}[int(signs[f])]
        goes = codes[rows, f] - f * bins <= b
        feature[node], threshold[node] = f, float(edges[f][b])
        left[node] = grow(rows[goes], level + 1, *bounds[0])
        right[node] = grow(rows[~goes], level + 1, *bounds[1])
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        first = len(feature)
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
        node = np.full(n, first)
        for _ in range(depth):
            f = np.array(feature)[node]
            node = np.where(x[np.arange(n), f] <= np.array(threshold)[node], np.array(left)[node], np.array(right)[node])
        margin = margin + np.array(value)[node]
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), depth, base)
