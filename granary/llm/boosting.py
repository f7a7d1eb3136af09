"""Small gradient-boosted trees: fitted in numpy on a bounded sample, scored as SQL expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Boosted:
    """Log-odds = start + the sum of the trees' leaves; a tree is (feature, cut, low, high) or a leaf."""

    def __init__(self, start: float, trees: list):
        self.start, self.trees = start, trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += _walk(tree, x)
        return out

    def expression(self, features: list[Column]) -> Column:
        """The log-odds as a Spark column of the features."""
        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + _column(tree, features)
        return total


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, cut, low, high = tree
    return np.where(x[:, feature] <= cut, _walk(low, x), _walk(high, x))


def _column(tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, low, high = tree
    return F.when(features[feature] <= F.lit(float(cut)), _column(low, features)).otherwise(_column(high, features))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.35, least: float = 4.0, ridge: float = 1.0) -> Boosted:
    """Logistic boosting with second-order leaves and exact cuts between at most 32 quantiles."""
    if not len(y):
        return Boosted(-8.0, [])
    mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
    start = float(np.log(mean / (1 - mean)))
    margins, trees = np.full(len(y), start), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33), method="lower"))[:-1] for f in range(x.shape[1])]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margins))
        slope, curve = y - p, p * (1 - p)

        def grow(rows: np.ndarray, left: int, slope=slope, curve=curve):
            g, h = slope[rows].sum(), curve[rows].sum()
            best, split = 1e-6, None
            for f in range(x.shape[1]) if left else ():
                for cut in cuts[f]:
                    low = x[rows, f] <= cut
                    n = low.sum()
                    if least <= n <= len(rows) - least:
                        a, b = slope[rows][low].sum(), curve[rows][low].sum()
                        gain = a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge)
                        if gain > best:
                            best, split = gain, (f, float(cut), low)
            if split is None:
                return float(rate * g / (h + ridge))
            f, cut, low = split
            return f, cut, grow(rows[low], left - 1), grow(rows[~low], left - 1)

        tree = grow(np.arange(len(y)), depth)
        trees.append(tree)
        margins += _walk(tree, x)
    return Boosted(start, trees)
