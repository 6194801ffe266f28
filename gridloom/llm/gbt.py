"""Gradient-boosted decision trees over dense features, and isotonic calibration, in numpy.

Trees grow level by level over binned features with the second-order gain of the logistic loss. A fitted
model is a few small arrays, to be sent to executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Trees:
    base: float = 0.0
    depth: int = 0
    #: For each tree: feature and threshold of its inner nodes (heap order), values of its leaves.
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 2.0, ridge: float = 1.0, drawn: float = 1.0) -> Trees:
    """Fit to labels 0 and 1. ``least``: of the hessian in a leaf; ``drawn``: the share of the rows that each tree grows on, drawn anew. One class only: a constant."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return model
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, inner, draw = np.full(n, model.base), 2**depth - 1, np.random.default_rng(0)
    whole_x, whole_y, whole_binned = x, y, binned.astype(np.int32)
    for _ in range(trees):
        some = np.flatnonzero(draw.random(n) < drawn) if drawn < 1 else slice(None)
        x, y, binned = whole_x[some], whole_y[some], whole_binned[some]
        p = _sigmoid(margin[some])
        g, h = p - y, p * (1 - p)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local, best = at - first, np.full(width, 1e-6)
            cut = np.zeros(width, np.int64)
            for j in range(k):
                size = len(edges[j]) + 1
                if size == 1:
                    continue
                cell = local * size + binned[:, j]
                gs, hs = (np.cumsum(np.bincount(cell, w, width * size).reshape(width, size), axis=1) for w in (g, h))
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                top = gain.argmax(axis=1)
                gain = gain[np.arange(width), top]
                better = gain > best
                best[better], cut[better] = gain[better], top[better]
                feature[first : first + width][better] = j
            for i in range(width):
                if best[i] > 1e-6:
                    threshold[first + i] = edges[feature[first + i]][cut[i]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -rate * gs / (hs + ridge)
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
        margin += Trees(0.0, depth, [feature], [threshold], [value]).margin(whole_x)
    return model


@dataclass
class Isotonic:
    """A non-decreasing map of scores to probabilities."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0, 1) if len(self.x) else score


def isotonic(score: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators over the scores; equal scores count as one point."""
    if not len(score):
        return Isotonic(np.zeros(0), np.zeros(0))
    points, inverse = np.unique(score, return_inverse=True)
    weights = np.ones(len(score)) if weights is None else weights
    weight, total = np.bincount(inverse, weights), np.bincount(inverse, y * weights)
    blocks: list[list[float]] = []  # weight, sum, first and last point
    for i in range(len(points)):
        blocks.append([weight[i], total[i], points[i], points[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2], last]
    return Isotonic(np.array([b[k] for b in blocks for k in (2, 3)]), np.array([b[1] / b[0] for b in blocks for _ in (0, 1)]))
