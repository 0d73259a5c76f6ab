"""Gradient-boosted regression trees on quantile bins, in numpy, for bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """A leaf if feature < 0. Rows with x <= cut go left."""

    value: float
    feature: int = -1
    cut: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


@dataclass
class Boosted:
    base: float
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += _apply(tree, x)
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    stack = [(node, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        if at.feature < 0 or not len(rows):
            out[rows] = at.value
            continue
        low = x[rows, at.feature] <= at.cut
        stack += [(at.left, rows[low]), (at.right, rows[~low])]
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: float, ridge: float, rate: float) -> Node:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    node = Node(-rate * total_g / (total_h + ridge))
    if not depth or total_h < 2 * least:
        return node
    best, where = 1e-6, None
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        own = binned[rows, f]
        gl = np.cumsum(np.bincount(own, g[rows], len(edges) + 1))[:-1]
        hl = np.cumsum(np.bincount(own, h[rows], len(edges) + 1))[:-1]
        ok = (hl >= least) & (total_h - hl >= least)
        gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
        gain[~ok] = 0
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, where = gain[at], (f, at)
    if where is None:
        return node
    f, at = where
    low = binned[rows, f] <= at
    node.feature, node.cut = f, float(cuts[f][at])
    node.left = _grow(binned, cuts, g, h, rows[low], depth - 1, least, ridge, rate)
    node.right = _grow(binned, cuts, g, h, rows[~low], depth - 1, least, ridge, rate)
    return node


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Logistic gradient boosting; the same rows in the same order give the same trees."""
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
    model = Boosted(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = []
    for f in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        cuts.append(edges[edges < x[:, f].max()])
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, least, ridge, rate)
        if tree.feature < 0:
            break
        model.trees.append(tree)
        margin += _apply(tree, x)
    return model
