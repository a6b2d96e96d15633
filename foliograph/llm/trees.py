"""Gradient-boosted trees on small matrices, flattened into numpy node arrays.

Logistic loss, histogram splits over quantile bins, depth-limited trees. A feature may be given a direction (1 or -1):
splits against it are refused and the children's values are held on their side of the split's midpoint,
so that the score is monotone in that feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees, one after the other; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 8, directions: dict[int, int] | None = None) -> Trees:
    """Trees for labels y in {0, 1}. One class only, or no row: a constant score."""
    directions = directions or {}
    n, f = x.shape if x.size else (0, x.shape[1] if x.ndim == 2 else 0)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base, roots = float(np.log(share / (1 - share))), []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
        signs = np.array([directions.get(j, 0) for j in range(f)])[:, None]
        valid = np.array([[b < len(edges[j]) for b in range(bins)] for j in range(f)])
        score = np.full(n, base)

        def leaf(value: float) -> int:
            at = len(nodes["value"])
            for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
                nodes[k].append(v)
            return at

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            at = leaf(rate * float(np.clip(-gs / (hs + ridge), low, high)))
            if level == 0 or rows.size < 2 * least:
                score[rows] += nodes["value"][at]
                return at
            flat = (binned[rows] + np.arange(f) * bins).ravel()
            hist = [np.bincount(flat, w, f * bins).reshape(f, bins).cumsum(axis=1) for w in (np.repeat(g[rows], f), np.repeat(h[rows], f), None)]
            gl, hl, nl = hist
            vl, vr = -gl / (hl + ridge), -(gs - gl) / (hs - hl + ridge)
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            bad = ~valid | (nl < least) | (rows.size - nl < least) | (signs * (vr - vl) < 0)
            gain = np.where(bad, -1, gain)
            j, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, b] <= 1e-6:
                score[rows] += nodes["value"][at]
                return at
            mid = float(np.clip((vl[j, b] + vr[j, b]) / 2, low, high))
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(signs[j, 0])]
            goes = binned[rows, j] <= b
            nodes["feature"][at], nodes["threshold"][at] = int(j), float(edges[j][b])
            nodes["left"][at] = grow(rows[goes], g, h, level - 1, *bounds[0])
            nodes["right"][at] = grow(rows[~goes], g, h, level - 1, *bounds[1])
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), depth, -np.inf, np.inf))
    arrays = {k: np.array(v, {"feature": np.int64, "left": np.int64, "right": np.int64}.get(k, float)) for k, v in nodes.items()}
    return Trees(**arrays, roots=np.array(roots, np.int64), depth=depth, base=base)
