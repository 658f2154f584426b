"""Gradient-boosted trees with logistic loss on binned features, fitted on a bounded sample.

The fitted model is a few small arrays: `score` applies it to a numpy matrix inside a task, `score_column` turns it
into nested CASE expressions that stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trees:
    """Trees in heap order: the children of node i are 2i+1 (x <= threshold) and 2i+2; feature -1 marks a leaf."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.25, least: int = 10, l2: float = 1.0) -> Trees:
    """x: rows by features, finite; y: 0 or 1. A sample of one class or no rows gives a constant model."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    size, width = 2 ** (depth + 1) - 1, x.shape[1]
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    feature, threshold, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    if not len(y) or y.min() == y.max():
        return Trees(start, feature[:0], threshold[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    f = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), int)
        for level in range(depth + 1):
            first, n = 2**level - 1, 2**level
            live = at >= first
            node = at[live] - first
            gain, best, cut = np.full(n, 1e-9), np.full(n, -1), np.zeros(n)
            gs, hs = np.bincount(node, g[live], n), np.bincount(node, h[live], n)
            value[t, first : first + n] = rate * gs / (hs + l2)
            if level == depth:
                break
            whole = gs**2 / (hs + l2)
            for j in range(width):
                if not len(edges[j]):
                    continue
                key = node * (bins + 1) + binned[live, j]
                sums = [np.bincount(key, w, n * (bins + 1)).reshape(n, bins + 1).cumsum(1)[:, : len(edges[j])] for w in (g[live], h[live], np.ones(len(key)))]
                right_g, right_h, right_n = gs[:, None] - sums[0], hs[:, None] - sums[1], np.bincount(node, minlength=n)[:, None] - sums[2]
                got = sums[0] ** 2 / (sums[1] + l2) + right_g**2 / (right_h + l2) - whole[:, None]
                got[(sums[2] < least) | (right_n < least)] = -1
                k = got.argmax(1)
                top = got[np.arange(n), k]
                better = top > gain
                gain, best, cut = np.where(better, top, gain), np.where(better, j, best), np.where(better, edges[j][k], cut)
            feature[t, first : first + n], threshold[t, first : first + n] = best, cut
            go = live & (best[np.clip(at - first, 0, n - 1)] >= 0)
            rows = np.flatnonzero(go)
            here = at[rows] - first
            at[rows] = 2 * at[rows] + 1 + (x[rows, best[here]] > cut[here])
        f += value[t, at]
    return Trees(start, feature, threshold, value)


def score(model: Trees, x: np.ndarray) -> np.ndarray:
    """The log-odds of class 1 for each row."""
    out = np.full(len(x), model.start)
    rows = np.arange(len(x))
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        at = np.zeros(len(x), int)
        while len(at) and (inner := (j := feature[at]) >= 0).any():
            at = np.where(inner, 2 * at + 1 + (x[rows, j] > threshold[at]), at)
        out += value[at]
    return out


def score_column(model: Trees, features: list[Column]) -> Column:
    """The log-odds of class 1 as one SQL expression over the feature columns."""

    def node(t: int, i: int) -> Column:
        if (j := int(model.feature[t, i])) < 0:
            return F.lit(float(model.value[t, i]))
        return F.when(features[j] <= float(model.threshold[t, i]), node(t, 2 * i + 1)).otherwise(node(t, 2 * i + 2))

    total = F.lit(model.start)
    for t in range(len(model.feature)):
        total = total + node(t, 0)
    return total
