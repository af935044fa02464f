"""Gradient-boosted regression trees on logistic loss, for a bounded training sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    """``trees`` of ``depth`` levels, each multiplied by ``rate``; ``bins`` thresholds a feature;
    ``ridge`` is added to a leaf's curvature and ``least`` is the curvature a leaf needs."""

    trees: int = 32
    depth: int = 4
    rate: float = 0.3
    bins: int = 32
    ridge: float = 1.0
    least: float = 1.0


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node i has the children 2i+1 and 2i+2; a row goes right where its
    feature is above the threshold."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(rows), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (rows[every, feature[at]] > threshold[at])
            out += value[at - inner]
        return out


def thresholds(rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each feature, between values that occur."""
    out = []
    for column in rows.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append(((values[1:].astype(np.float64) + values[:-1]) / 2).astype(np.float32))
    return out


def fit(rows: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Trees:
    """Trees for labels 0 and 1.  Rows of each label weigh the same in all."""
    cuts = thresholds(rows, settings.bins)
    # feature by feature, so that a pass over one reads neighbouring memory
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, rows.T)])
    useful = [f for f, c in enumerate(cuts) if len(c)]
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    score = np.zeros(len(rows))
    inner, leaves = 2**settings.depth - 1, 2**settings.depth
    feature = np.zeros((settings.trees, inner), np.int64)
    threshold = np.full((settings.trees, inner), np.inf, np.float32)
    value = np.zeros((settings.trees, leaves))
    for tree in range(settings.trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = weight * (labels - p), weight * p * (1 - p)
        at = np.zeros(len(rows), np.int64)
        for level in range(settings.depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            cut = np.full(nodes, settings.bins + 1)
            local = at - first
            for f in useful:
                width = len(cuts[f]) + 1
                cell = local * width + binned[f]
                g = np.bincount(cell, slope, nodes * width).reshape(nodes, width).cumsum(axis=1)
                h = np.bincount(cell, curve, nodes * width).reshape(nodes, width).cumsum(axis=1)
                gain = g**2 / (h + settings.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + settings.ridge)
                gain -= g[:, -1:] ** 2 / (h[:, -1:] + settings.ridge)
                gain[(h < settings.least) | (h[:, -1:] - h < settings.least)] = 0
                place = gain[:, :-1].argmax(axis=1)
                found = gain[np.arange(nodes), place]
                better = found > best
                best[better], cut[better] = found[better], place[better]
                feature[tree, first : first + nodes][better] = f
                threshold[tree, first : first + nodes][better] = cuts[f][place[better]]
            at = 2 * at + 1 + (binned[feature[tree, at], np.arange(len(rows))] > cut[local])
        leaf = at - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, curve, leaves)
        value[tree] = settings.rate * g / (h + settings.ridge)
        score += value[tree][leaf]
    return Trees(0.0, feature, threshold, value)
