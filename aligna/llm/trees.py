"""Gradient trees over binned features, with monotonic constraints; shared by the two quality models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes as arrays; feature -1 marks a leaf. A row goes left where its feature <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            go = x[inner, f[inner]] <= self.threshold[at[inner]]
            at[inner] = np.where(go, self.left[at[inner]], self.right[at[inner]])


def edges(x: np.ndarray, bins: int = 48) -> list[np.ndarray]:
    """Candidate thresholds of each feature: midpoints between its distinct quantiles."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1))) if len(column) else np.zeros(0)
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(x, cuts, g, h, depth: int, least: int, lam: float = 1.0, monotone=None) -> Tree:
    """A regression tree for gradients g and curvatures h (Newton leaf values).

    monotone: for each feature 1, -1 or 0; a split that breaks the order of its leaf values is refused, and both
    sides keep to their side of the middle value, so that the whole tree is monotonic.
    """
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
    monotone = monotone if monotone is not None else [0] * x.shape[1]
    nodes: list[list] = []

    def leaf(rows, lo, hi):
        return float(np.clip(-g[rows].sum() / (h[rows].sum() + lam), lo, hi))

    def build(rows, level, lo, hi):
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, leaf(rows, lo, hi)])
        if level == 0 or len(rows) < 2 * least:
            return me
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best, how = 1e-6, None
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, f]
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + lam), lo, hi), np.clip(-gr / (hr + lam), lo, hi)
            gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - total_g**2 / (total_h + lam)
            ok = (n >= least) & (len(rows) - n >= least) & (monotone[f] * (vr - vl) >= 0)
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, how = gain[k], (f, k, vl[k], vr[k])
        if how:
            f, k, vl, vr = how
            left = binned[rows, f] <= k
            mid = (vl + vr) / 2
            bounds = ((lo, hi), (lo, hi)) if not monotone[f] else (((lo, mid), (mid, hi)) if monotone[f] > 0 else ((mid, hi), (lo, mid)))
            nodes[me][:2] = [f, float(cuts[f][k])]
            nodes[me][2] = build(rows[left], level - 1, *bounds[0])
            nodes[me][3] = build(rows[~left], level - 1, *bounds[1])
        return me

    build(np.arange(len(x)), depth, -np.inf, np.inf)
    feature, threshold, left, right, value = zip(*nodes, strict=True)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def boost(x, y, rounds: int, depth: int, rate: float, least: int = 20, share: float = 0.5, seed: int = 3, monotone=None) -> tuple[float, list[Tree]]:
    """Logistic boosting: base log-odds, and trees whose values hold the rate. Too few rows or one class: no trees."""
    if not len(y):
        return 0.0, []
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return base, []
    rng, cuts, z, out = np.random.default_rng(seed), edges(x), np.full(len(y), base), []
    for _ in range(rounds):
        rows = np.sort(rng.permutation(len(y))[: max(1, int(share * len(y)))])
        p = 1 / (1 + np.exp(-z[rows]))
        tree = grow(x[rows], cuts, p - y[rows], p * (1 - p), depth, least, monotone=monotone)
        tree.value = tree.value * rate
        z += tree.predict(x)
        out.append(tree)
    return base, out
