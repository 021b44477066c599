"""Small regression trees, boosting, isotonic calibration and lasso for models fitted on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np


class Tree:
    """Nodes as arrays: feature (-1 at a leaf), threshold (left if <=), left, right, value."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1

    def apply(self, x: np.ndarray) -> np.ndarray:
        f, t, l, r, v = map(np.asarray, (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(f[at] >= 0)
            if not len(inner):
                return v[at]
            node = at[inner]
            at[inner] = np.where(x[inner, f[node]] <= t[node], l[node], r[node])


def edges_of(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, edges: list[np.ndarray], depth: int, least: int = 20, ridge: float = 1.0) -> Tree:
    """A tree on binned features that lowers the second-order loss; leaves hold -G / (H + ridge)."""
    tree = Tree()
    binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]

    def leaf(rows):
        return -gradient[rows].sum() / (hessian[rows].sum() + ridge)

    def split(node, rows, left_depth):
        if left_depth == 0 or len(rows) < 2 * least:
            return
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[j][rows]
            n = len(e) + 1
            gs, hs, cs = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (gradient[rows], hessian[rows], None))
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            gain[(cs < least) | (len(rows) - cs < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] is None:
            return
        j, k = best[1], best[2]
        go = binned[j][rows] <= k
        tree.feature[node], tree.threshold[node] = j, float(edges[j][k])
        for side, part in (("left", rows[go]), ("right", rows[~go])):
            child = tree.add(leaf(part))
            getattr(tree, side)[node] = child
            split(child, part, left_depth - 1)

    rows = np.arange(len(x))
    split(tree.add(leaf(rows) if len(rows) else 0.0), rows, depth)
    return tree


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> tuple[float, list[Tree]]:
    """Gradient-boosted trees for a 0/1 label: (start, trees); the score is sigmoid(start + rate-scaled leaves)."""
    share = min(0.999, max(0.001, y.mean() if len(y) else 0.5))
    start = float(np.log(share / (1 - share)))
    z, edges, trees = np.full(len(y), start), edges_of(x), []
    for _ in range(rounds if len(np.unique(y)) > 1 else 0):
        p = sigmoid(z)
        tree = grow(x, p - y, p * (1 - p), edges, depth)
        tree.value = [rate * v for v in tree.value]
        trees.append(tree)
        z += tree.apply(x)
    return start, trees


def margin(start: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), start)
    for t in trees:
        z += t.apply(x)
    return z


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step function nearest to y (pool adjacent violators), to interpolate between."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, v in zip(scores[order].tolist(), y[order].tolist()):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            a = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = b[0] + a[0], b[1] + a[1], a[3]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    # one success and one failure more over all blocks keep the ends off 0 and 1
    ys = np.array([v for b in blocks for v in [(b[0] + 0.5 / len(blocks)) / (b[1] + 1 / len(blocks))] * 2])
    return xs, np.maximum.accumulate(ys)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty (mean loss + penalty * |w|) by accelerated proximal gradient steps."""
    n, k = x.shape
    w, b = np.zeros(k), 0.0
    if not n:
        return b, w
    step = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1.0)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = (sigmoid(x @ vw + vb) - y) / n
        nw, nb = vw - step * (x.T @ r), vb - step * r.sum()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w
