"""Gradient-boosted trees for two classes: logistic loss, Newton steps, splits between quantile bins, a share of the rows a tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS, LEAST, PENALTY, SHARE = 100, 4, 0.25, 32, 4.0, 1.0, 0.4


@dataclass
class Trees:
    start: float
    cuts: list[np.ndarray]  # of each feature
    feature: np.ndarray  # trees x inner nodes, heap order
    cut: np.ndarray  # the last bin that goes left
    leaf: np.ndarray  # trees x leaves

    def binned(self, features: list[np.ndarray]) -> np.ndarray:
        """features x rows"""
        return np.array([np.searchsorted(c, f).astype(np.uint8) for c, f in zip(self.cuts, features, strict=True)])

    def score(self, features: list[np.ndarray]) -> np.ndarray:
        """Log odds of the rows."""
        used = np.unique(self.feature)
        n = len(features[0])
        x = np.empty((len(features), n), np.uint8)  # only rows of features in use are filled
        for f in used:
            x[f] = np.searchsorted(self.cuts[f], features[f])
        total = np.full(n, self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            total += leaf[_leaves(x, feature, cut)]
        return total


def _leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row (a column of ``x``) in one tree."""
    rows = np.arange(x.shape[1])
    at = np.zeros(len(rows), np.int64)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[feature[at], rows] > cut[at])
    return at - len(feature)


def fit(features: list[np.ndarray], wanted: np.ndarray, weight: np.ndarray) -> Trees:
    """Trees for the classes 0 and 1 in ``wanted``."""
    cuts = []
    for f in features:
        values = np.unique(f)
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) < BINS else np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])))
    share = np.clip(np.average(wanted, weights=weight), 1e-3, 1 - 1e-3)
    inner = 2**DEPTH - 1
    model = Trees(float(np.log(share / (1 - share))), cuts, np.zeros((TREES, inner), np.int64), np.full((TREES, inner), 255, np.int64), np.zeros((TREES, inner + 1)))
    x = model.binned(features)
    total = np.full(len(wanted), model.start)
    flags = np.array([f for f, c in enumerate(cuts) if len(c) == 1], np.int64)
    others = [f for f, c in enumerate(cuts) if len(c) > 1]
    r = np.random.default_rng(len(wanted))
    whole = x
    for t in range(TREES):
        rows = np.flatnonzero(r.random(len(wanted)) < SHARE)
        x = whole[:, rows]
        up = x[flags].astype(np.float32)  # flags: one product has all their sums
        everyone = np.arange(len(rows))
        p = 1 / (1 + np.exp(-total[rows]))
        slope, bend = weight[rows] * (wanted[rows] - p), weight[rows] * p * (1 - p)
        at = np.zeros(len(rows), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            node = at - first
            all_g, all_h = np.bincount(node, slope, many)[:, None], np.bincount(node, bend, many)[:, None]

            def gains(g: np.ndarray, h: np.ndarray, all_g: np.ndarray = all_g, all_h: np.ndarray = all_h) -> np.ndarray:
                gain = g**2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
                gain[(h < LEAST) | (all_h - h < LEAST)] = 0
                return gain

            best, feature, cut = np.full(many, 1e-9), np.zeros(many, np.int64), np.full(many, 255)
            if len(flags):
                sides = np.zeros((len(node), 2 * many), np.float32)
                sides[everyone, node], sides[everyone, many + node] = slope, bend
                right = (up @ sides).T.astype(np.float64)
                gain = gains(all_g - right[:many], all_h - right[many:])
                b = gain.argmax(1)
                better = gain[np.arange(many), b] > best
                best[better], feature[better], cut[better] = gain[np.arange(many), b][better], flags[b][better], 0
            for f in others:
                slot = node * BINS + x[f]
                g = np.bincount(slot, slope, many * BINS).reshape(many, BINS).cumsum(1)
                gain = gains(g, np.bincount(slot, bend, many * BINS).reshape(many, BINS).cumsum(1))
                b = gain.argmax(1)
                better = gain[np.arange(many), b] > best
                best[better], feature[better], cut[better] = gain[np.arange(many), b][better], f, b[better]
            model.feature[t, first : first + many], model.cut[t, first : first + many] = feature, cut
            at = 2 * at + 1 + (x[feature[node], everyone] > cut[node])
        at -= inner
        g, h = np.bincount(at, slope, inner + 1), np.bincount(at, bend, inner + 1)
        model.leaf[t] = RATE * g / (h + PENALTY)
        total += model.leaf[t][_leaves(whole, model.feature[t], model.cut[t])]
    return model
