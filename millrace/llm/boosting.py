"""Small gradient-boosted trees fitted on a bounded sample, scored as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> Node:
    """Newton tree: splits by gain in the second-order loss, leaves by -G / (H + ridge)."""
    node = Node(value=float(-g.sum() / (h.sum() + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return node
    whole, best = g.sum() ** 2 / (h.sum() + ridge), 1e-6
    for f in range(x.shape[1]):
        values, at = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        gs, hs, ns = (np.cumsum(np.bincount(at, w))[:-1] for w in (g, h, np.ones(len(g))))
        gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - whole
        gain[(ns < least) | (len(x) - ns < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, node.feature, node.cut = float(gain[k]), f, float(values[k])
    if node.feature >= 0:
        left = x[:, node.feature] <= node.cut
        node.low = _tree(x[left], g[left], h[left], depth - 1, least, ridge)
        node.high = _tree(x[~left], g[~left], h[~left], depth - 1, least, ridge)
    return node


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    left = x[:, node.feature] <= node.cut
    out = np.empty(len(x))
    out[left], out[~left] = _apply(node.low, x[left]), _apply(node.high, x[~left])
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3) -> tuple[float, list[Node]]:
    """Logistic boosting; returns the base score and the trees."""
    if not len(y):
        return -4.0, []
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    z, trees = np.full(len(y), base), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        tree = _tree(x, q - y, q * (1 - q), depth, max(2, len(y) // 200), 1.0)
        trees.append(tree)
        z += rate * _apply(tree, x)
    return base, trees


def raw_scores(model: tuple[float, list[Node]], x: np.ndarray, rate: float = 0.3) -> np.ndarray:
    return model[0] + rate * sum((_apply(t, x) for t in model[1]), np.zeros(len(x)))


def score_column(model: tuple[float, list[Node]], features: list[Column], rate: float = 0.3) -> Column:
    """The log-odds as nested CASE expressions, evaluated in the JVM."""

    def expr(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(rate * node.value)
        return F.when(features[node.feature] <= node.cut, expr(node.low)).otherwise(expr(node.high))

    total = F.lit(model[0])
    for t in model[1]:
        total = total + expr(t)
    return total
