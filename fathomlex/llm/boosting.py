"""Gradient-boosted trees for binary labels, and isotonic calibration; plain numpy, for training sets that fit a driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees of one depth: ``feature`` and ``cut`` of each inner node, ``value`` of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over histograms of ``BINS`` quantile bins."""
    n, m = x.shape
    p0 = (y.sum() + 1) / (n + 2)
    base = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(m)] if n else [np.zeros(1)] * m
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), np.int64)
    inner, leaves = 2**depth - 1, 2**depth
    features, bounds, values = [], [], []
    margin = np.full(n, base)
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for k in range(inner):
            here = np.flatnonzero(node == k)
            if not len(here):
                node[here] = 2 * k + 1
                continue
            best = (1e-6, None)
            gt, ht = g[here].sum(), h[here].sum()
            for j in range(m):
                b = binned[here, j]
                gl, hl = np.cumsum(np.bincount(b, g[here], BINS + 1))[: len(cuts[j])], np.cumsum(np.bincount(b, h[here], BINS + 1))[: len(cuts[j])]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (j, i))
            right = np.zeros(len(here), bool)
            if best[1] is not None:
                j, i = best[1]
                f[k], c[k] = j, cuts[j][i]
                right = binned[here, j] > i
            node[here] = 2 * k + 1 + right
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += v[leaf]
        features.append(f)
        bounds.append(c)
        values.append(v)
    shape = (len(values), inner)
    return Trees(np.array(features, np.int64).reshape(shape), np.array(bounds, np.float64).reshape(shape), np.array(values, np.float64).reshape(len(values), leaves), base)


@dataclass
class Isotonic:
    """A rising step function, linear between its points."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return np.interp(v, self.x, self.y)


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; a row of each class at either end keeps the result within (0, 1)."""
    if not len(score):
        return Isotonic(np.array([-1.0, 1.0]), 1 / (1 + np.exp(-np.array([-1.0, 1.0]))))
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(np.float64)
    blocks: list[list[float]] = []
    for a, b in zip(np.r_[s[0], s, s[-1]], np.r_[0.5, v, 0.5]):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t, w, _, hi = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w
            blocks[-1][3] = hi
    x, p = [], []
    for t, w, lo, hi in blocks:
        for edge in (lo, hi) if hi > lo else (lo,):
            x.append(edge)
            p.append(t / w)
    return Isotonic(np.array(x), np.array(p))
