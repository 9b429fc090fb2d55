"""Gradient-boosted trees with monotonic constraints, flattened into arrays.

Logistic loss, histogram splits, depth-wise growth.  Training runs in the
driver on a bounded sample; scoring is vectorised over node arrays and runs in
tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees one after the other: node i splits on ``feature[i]`` (-1: a
    leaf) at ``at[i]``; values up to it, and nan, go to ``low[i]``, others to
    ``high[i]``; ``value[i]`` is a leaf's part of the log-odds."""

    feature: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                v = x[rows, np.maximum(f, 0)]
                step = np.where(v > self.at[node], self.high[node], self.low[node])
                node = np.where(f >= 0, step, node)
            out += self.value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def _bins(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds per feature: midpoints between distinct quantiles."""
    out = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1), method="nearest")) if len(col) else np.empty(0)
        out.append((q[1:] + q[:-1]) / 2)
    return out


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4,
          rate: float = 0.2, bins: int = 48, reg: float = 1.0, least: int = 8) -> Forest:
    """``monotone[f]``: 1 if the score may only rise with feature f, -1 if it
    may only fall, 0 if it is free.  A split on a constrained feature must
    order its two values accordingly, and both children are bounded by the
    middle between them, so no deeper split can break the order."""
    n, p = len(y), float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    cuts = _bins(x, bins)
    width = max((len(c) for c in cuts), default=0) + 1
    code = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1) if n else np.zeros((0, len(cuts)), int)
    offset = np.arange(x.shape[1]) * width
    feature, at, low, high, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def node() -> int:
        for a, v in ((feature, -1), (at, 0.0), (low, 0), (high, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def best_split(rows, g, h, lo, hi):
        flat = (code[rows] + offset).ravel()
        each = x.shape[1]
        size = each * width
        gs, hs, cs = (np.bincount(flat, np.repeat(w, each), size).reshape(each, width).cumsum(axis=1)
                      for w in (g[rows], h[rows], np.ones(len(rows))))
        gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
        left = np.clip(-gs / (hs + reg), lo, hi)
        right = np.clip(-(gt - gs) / (ht - hs + reg), lo, hi)

        def loss(v, grad, hess):
            return grad * v + 0.5 * (hess + reg) * v * v

        whole = np.clip(-gt / (ht + reg), lo, hi)
        gain = loss(whole, gt, ht) - loss(left, gs, hs) - loss(right, gt - gs, ht - hs)
        ok = (cs >= least) & (ct - cs >= least) & (monotone[:, None] * (right - left) >= 0)
        for f, c in enumerate(cuts):
            ok[f, len(c):] = False
        gain = np.where(ok, gain, -np.inf)
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        return (gain[f, b], f, b, left[f, b], right[f, b]) if gain[f, b] > 1e-9 else None

    for _ in range(trees if n else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        roots.append(node())
        work = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while work:
            k, rows, lo, hi, level = work.pop()
            split = best_split(rows, g, h, lo, hi) if level < depth else None
            if split is None:
                v = float(np.clip(-g[rows].sum() / (h[rows].sum() + reg), lo, hi)) * rate
                value[k] = v
                margin[rows] += v
                continue
            _, f, b, lv, rv = split
            feature[k], at[k], low[k], high[k] = int(f), float(cuts[f][b]), node(), node()
            goes = code[rows, f] > b
            middle = (lv + rv) / 2
            bounds = {1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle)), 0: ((lo, hi), (lo, hi))}[int(monotone[f])]
            work += [(low[k], rows[~goes], *bounds[0], level + 1), (high[k], rows[goes], *bounds[1], level + 1)]
    return Forest(np.array(feature, np.int32), np.array(at), np.array(low, np.int32), np.array(high, np.int32),
                  np.array(value), np.array(roots, np.int32), depth, base)
