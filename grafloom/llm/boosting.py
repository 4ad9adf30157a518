"""Gradient-boosted trees for two classes: Newton steps on the logistic loss, trees grown level by level on yes-no splits.

A split asks whether a feature is at least a threshold; thresholds are quantiles of the training rows.  The sums of
gradients of all splits of a level are one matrix product.
"""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, thresholds: int = 16, ridge: float = 4.0):
        self.n, self.depth, self.rate, self.thresholds, self.ridge = trees, depth, rate, thresholds, ridge
        self.bias = 0.0
        self.feature = np.zeros((0, (1 << depth) - 1), np.int64)
        self.least = np.zeros((0, (1 << depth) - 1))
        self.value = np.zeros((0, 1 << depth))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        feature, least = [], []
        for k in range(x.shape[1] if len(x) else 0):
            cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.thresholds + 2)[1:-1], method="higher"))
            if len(cuts) <= 2:  # a rare value lies between no two quantiles
                cuts = np.unique(x[:, k])[: self.thresholds]
            cuts = cuts[cuts > x[:, k].min()]
            feature += [k] * len(cuts)
            least += cuts.tolist()
        feature, least = np.array(feature, np.int64), np.array(least)
        if not len(feature) or y.min(initial=1) == y.max(initial=0):
            self.bias = 8.0 if len(y) and y.all() else -8.0
            return self
        asked = (x[:, feature] >= least).astype(np.float32)
        mean = np.average(y, weights=weight)
        self.bias = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.bias)
        features, leasts, values = [], [], []
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-score))
            grad, hess = (weight * (y - p)), weight * p * (1 - p)
            leaf, f_row, t_row = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                many = 1 << level
                sums = np.zeros((len(y), 2 * many), np.float32)
                sums[np.arange(len(y)), leaf], sums[np.arange(len(y)), many + leaf] = grad, hess
                yes = (asked.T @ sums).astype(np.float64)
                total = sums.sum(axis=0, dtype=np.float64)
                g, h, gs, hs = yes[:, :many], yes[:, many:], total[:many], total[many:]
                gain = g**2 / (h + self.ridge) + (gs - g) ** 2 / (np.maximum(hs - h, 0) + self.ridge)
                best = gain.argmax(axis=0)
                f_row += feature[best].tolist()
                t_row += least[best].tolist()
                leaf = 2 * leaf + (asked[np.arange(len(y)), best[leaf]] > 0)
            value = self.rate * np.bincount(leaf, grad, 1 << self.depth) / (np.bincount(leaf, hess, 1 << self.depth) + self.ridge)
            score += value[leaf]
            features.append(f_row)
            leasts.append(t_row)
            values.append(value)
        self.feature, self.least, self.value = np.array(features), np.array(leasts), np.array(values)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, least, value in zip(self.feature, self.least, self.value):
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[at]] >= least[at])
            out += value[leaf]
        return out
