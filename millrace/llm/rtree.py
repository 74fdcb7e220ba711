"""R-trees over count vectors, searched under an overlap bound."""

from __future__ import annotations

import numpy as np

LEAF, FANOUT = 32, 16
#: Directions whose signs order the points before they are packed, so that near points share leaves.
_TURNS = 8


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=1, dtype=np.int32 if a.dtype.itemsize < 4 else np.int64).astype(np.int64)


class CountTree:
    """Points packed bottom-up, 32 to a leaf, 16 children to a node; near points come side by side.

    Each node keeps the largest count per coordinate and the range of sizes
    below it. Two sets share at most the sum of the coordinate-wise minima of
    their counts, and the minima of a point and a node bound all pairs of the
    point with what lies below.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        if len(sizes) > LEAF:
            turns = np.random.default_rng(counts.shape[1]).choice([-1, 1], (counts.shape[1], _TURNS)).astype(np.float32)
            side = (counts.astype(np.float32) @ turns > 0) @ (1 << np.arange(_TURNS))
            self.order = np.lexsort((sizes, side))
        else:
            self.order = np.arange(len(sizes))
        self.points, self.sizes = counts[self.order], sizes[self.order].astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high, step = self.points, self.sizes, self.sizes, LEAF
        while len(top) > step:
            first = np.arange(0, len(top), step)
            top, low, high = (f.reduceat(x, first, axis=0) for f, x in ((np.maximum, top), (np.minimum, low), (np.maximum, high)))
            self.levels.append((top, low, high))
            step = FANOUT

    def leaf_pairs(self, num: int, den: int, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a tree that is one leaf: the index pairs i < j, marked in ``apart``, that may reach similarity num/den."""
        n = self.sizes
        i, j = np.nonzero(np.triu(apart, 1) & (den * n[:, None] >= num * n) & (den * n >= num * n[:, None]))
        if len(i):
            ok = (num + den) * _overlap(self.points[i], self.points[j]) >= num * (n[i] + n[j])
            i, j = i[ok], j[ok]
        return i, j

    def search(self, point: np.ndarray, size: int, num: int, den: int, open_: np.ndarray) -> np.ndarray:
        """Indices, of those marked in ``open_``, of the points that may reach similarity num/den with ``point``."""

        def fitting(at: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            at = at[(den * high[at] >= num * size) & (den * size >= num * low[at])]
            # overlap / (|A| + |B| - overlap) >= num / den, for the smallest set below
            return at[(num + den) * _overlap(top[at], point) >= num * (low[at] + size)] if len(at) else at

        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.sizes))
        for k in range(len(self.levels) - 1, -1, -1):
            at = fitting(at, *self.levels[k])
            step, below = (FANOUT, len(self.levels[k - 1][0])) if k else (LEAF, len(self.sizes))
            at = (at[:, None] * step + np.arange(step)).ravel()
            at = at[at < below]
        return self.order[fitting(at[open_[self.order[at]]], self.points, self.sizes, self.sizes)]
