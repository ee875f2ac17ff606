"""Histogram gradient-boosted trees for two classes, fitted with numpy and kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in one set of arrays: a node's split feature, threshold, children and value; leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Log-odds of label 1 for each row of `x`; every tree descends one level per numpy step."""
        out = np.full(len(x), self.base)
        if not len(self.roots):
            return out
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            row = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + rows] += self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 4.0) -> Forest:
    """Boost `trees` trees on the logistic loss.

    Features are cut into at most `bins` quantile bins; each level of a tree takes one histogram of gradients over
    (node, feature, bin) and picks every node's best split. `least` is the smallest hessian sum of a child. Without rows,
    or with one class only, the forest has no trees and gives the (smoothed) share of label 1.
    """
    n, width = x.shape if x.ndim == 2 else (0, 0)
    share = (y.sum() + 1.0) / (n + 2.0) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        none = np.zeros(0, dtype=np.int64)
        return Forest(none, np.zeros(0), none, none, np.zeros(0), none, 0, base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    flat = binned + np.arange(width) * bins
    margin = np.full(n, base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def leaf() -> int:
        me = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", me), ("right", me), ("value", 0.0)):
            nodes[k].append(v)
        return me

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at, open_nodes = np.zeros(n, dtype=np.int64), [leaf()]
        roots.append(open_nodes[0])
        names = np.array(open_nodes)
        for level in range(depth + 1):
            count = len(open_nodes)
            live = at >= 0
            gs, hs = (np.bincount(at[live], weights=v[live], minlength=count) for v in (g, h))
            for i, node in enumerate(open_nodes):
                nodes["value"][node] = -rate * gs[i] / (hs[i] + l2)
            if level == depth:
                break
            cell = (at[live, None] * (width * bins) + flat[live]).ravel()
            gh, hh = (np.bincount(cell, weights=np.repeat(v[live], width), minlength=count * width * bins).reshape(count, width, bins).cumsum(axis=2) for v in (g, h))
            gl, hl, gt, ht = gh, hh, gs[:, None, None], hs[:, None, None]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -np.inf
            for j in range(width):
                gain[:, j, len(cuts[j]) :] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            to, below = np.full((count, 2), -1), []
            pick = np.zeros((count, 2), dtype=np.int64)
            for i, node in enumerate(open_nodes):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9:
                    pick[i] = j, b
                    nodes["feature"][node], nodes["threshold"][node] = j, float(cuts[j][b])
                    for side, name in enumerate(("left", "right")):
                        nodes[name][node] = leaf()
                        to[i, side] = len(below)
                        below.append(nodes[name][node])
            rows = np.flatnonzero(live)
            where = at[rows]
            goes_right = binned[rows, pick[where, 0]] > pick[where, 1]
            moved = to[where, goes_right.astype(np.int64)]
            stay = moved < 0
            margin[rows[stay]] += np.array(nodes["value"])[names[where[stay]]]
            at[rows] = moved
            open_nodes, names = below, np.array(below)
            if not below:
                break
        else:
            continue
        if open_nodes:
            rows = np.flatnonzero(at >= 0)
            margin[rows] += np.array(nodes["value"])[names[at[rows]]]
    kinds = {"feature": np.int64, "left": np.int64, "right": np.int64}
    return Forest(*(np.array(nodes[k], dtype=kinds.get(k, float)) for k in ("feature", "threshold", "left", "right", "value")), np.array(roots), depth, base)
