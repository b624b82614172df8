"""Gradient boosted trees over features that are 0 or 1, and their SQL.

Fitting takes a table of distinct feature vectors with weights, which has at most as many rows as the
labelled sample; scoring is an expression that Spark compiles into the query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

TREES = 24
RATE = 0.5
PENALTY = 1.0

Row = tuple[tuple[int, ...], float, float]  # features, weight of label 1, weight of label 0


@dataclass(frozen=True)
class Tree:
    """A split and, on either side, another split with two leaves or one leaf."""

    feature: int
    sides: tuple[tuple[int, float, float], tuple[int, float, float]]  # second feature, leaf where it is 0, leaf where it is 1

    def value(self, x: tuple[int, ...]) -> float:
        second, low, high = self.sides[x[self.feature]]
        return high if x[second] else low

    def sql(self, x: str) -> str:
        side = [f"if({x}[{f}] = 1, {high:.9f}D, {low:.9f}D)" for f, low, high in self.sides]
        return f"if({x}[{self.feature}] = 1, {side[1]}, {side[0]})"


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[Row], trees: int = TREES) -> list[Tree]:
    """Newton boosting of the logistic loss; of equal splits the first feature.

    The sums of any two features' four leaves come from two products of the feature matrix with itself.
    """
    x = np.array([r[0] for r in rows], float)
    a, b = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    margins = np.zeros(len(rows))
    out: list[Tree] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
        leaves = []  # by value of the first and of the second feature: gradients and curvatures
        for v in (a * (1 - p) - b * p, (a + b) * p * (1 - p)):
            both = (x * v[:, None]).T @ x
            one = both.diagonal()
            leaves.append([[v.sum() - one[:, None] - one[None, :] + both, one[None, :] - both], [one[:, None] - both, both]])
        value = [[RATE * leaves[0][i][j] / (leaves[1][i][j] + PENALTY) for j in (0, 1)] for i in (0, 1)]
        gain = [sum(leaves[0][i][j] ** 2 / (leaves[1][i][j] + PENALTY) for j in (0, 1)) for i in (0, 1)]
        second = [np.round(g, 9).argmax(1) for g in gain]
        first = int(np.round(gain[0].max(1) + gain[1].max(1), 9).argmax())
        tree = Tree(first, tuple((int(second[i][first]), float(value[i][0][first, second[i][first]]), float(value[i][1][first, second[i][first]])) for i in (0, 1)))
        out.append(tree)
        margins += np.array([tree.value(r[0]) for r in rows])
    return out


def margin(trees: list[Tree], x: tuple[int, ...]) -> float:
    return sum(t.value(x) for t in trees)


def calibrate(points: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Slope and bias of a logistic curve through (margin, weight of 1, weight of 0), by gradient steps with a small penalty."""
    a, b = 1.0, 0.0
    total = sum(p + q for _, p, q in points) or 1.0
    for _ in range(400):
        ga = gb = 0.0
        for m, p, q in points:
            e = p - (p + q) * sigmoid(a * m + b)
            ga += e * m
            gb += e
        a += 0.5 * ga / total - 1e-3 * (a - 1)
        b += 0.5 * gb / total
    return a, b


def threshold(points: list[tuple[float, float, float]], precision: float) -> float:
    """Half way between the least of the probabilities seen from which on the precision holds and the next one below; above 1 if it never holds."""
    best, good, bad = None, 0.0, 0.0
    ranked = sorted(points, reverse=True)
    for i, (_, p, q) in enumerate(ranked):
        good += p
        bad += q
        if good >= precision * (good + bad):
            best = i
    if best is None:
        return 1.1
    return (ranked[best][0] + (ranked[best + 1][0] if best + 1 < len(ranked) else 0.0)) / 2
