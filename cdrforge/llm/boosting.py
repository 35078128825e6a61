"""Gradient-boosted regression trees for log-odds, on binned features."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 32


class Trees(NamedTuple):
    """Complete binary trees: split features and thresholds by heap position, and leaves."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; ``least``: sum of curvature in a child."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(q, c) for q, c in zip(cuts, x.T, strict=True)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, inner = float(np.log(p / (1 - p))), 2**depth - 1
    margin = np.full(len(y), bias)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            node = at - base
            best = np.full(width, 1e-6)
            for f, q in enumerate(cuts):
                if not len(q):
                    continue
                key = node * BINS + binned[:, f]
                gs, hs = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = -1
                gain = gain[:, : len(q)]
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                won = top > best
                best[won] = top[won]
                feature[base:][:width][won] = f
                threshold[base:][:width][won] = q[cut[won]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + ridge) * rate
        margin += leaf[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(bias, np.array(features), np.array(thresholds), np.array(leaves))
