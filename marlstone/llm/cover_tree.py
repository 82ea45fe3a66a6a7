"""Cover trees over unit vectors and a dual traversal that finds every pair within a distance.

The levels of a tree are nested and halve their radii: a node's children have centres among its points,
its own centre first, and each covers the points within half of the node's radius. Two nodes whose
centres are farther apart than both covering radii and the distance sought have no pair between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 32
#: distances come from a difference that is off by 1e-15 or so, so near 0 they are off by 3e-8
_SLACK = 1e-7
_PAIRS = 200_000


class CoverTree:
    def __init__(self, x: np.ndarray):
        self.x = x
        self.center: list[int] = []
        self.radius: list[float] = []
        self.points: list[np.ndarray] = []
        self.children: list[np.ndarray | None] = []
        if len(x):
            self._grow(self._node(0, np.arange(len(x))))

    def _node(self, center: int, points: np.ndarray) -> int:
        self.center.append(center)
        far = 2 - 2 * (self.x[points] @ self.x[center])
        self.radius.append(float(np.sqrt(max(0.0, far.max()))))
        self.points.append(points)
        self.children.append(None)
        return len(self.center) - 1

    def _grow(self, root: int) -> None:
        todo = [root]
        while todo:
            node = todo.pop()
            left, limit = self.points[node], self.radius[node] / 2
            if len(left) <= LEAF or self.radius[node] <= 1e-6:
                continue
            own, center = [], self.center[node]
            while len(left):
                near = 2 - 2 * (self.x[left] @ self.x[center]) <= limit * limit
                near |= left == center
                child = self._node(center, left[near])
                own.append(child)
                todo.append(child)
                left = left[~near]
                if len(left):
                    center = int(left[0])
            self.children[node] = np.array(own)
            self.points[node] = left  # inner nodes hold no points


def _cross(counts_a: np.ndarray, counts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of groups with so many members: pair number, member number on each side, for all combinations."""
    size = counts_a * counts_b
    pair = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    return pair, within // counts_b[pair], within % counts_b[pair]


def close_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with a.x[i] . b.x[j] >= cosine, in chunks; with a is b each pair once, i < j."""
    if not a.center or not b.center:
        return
    reach = float(np.sqrt(2 - 2 * cosine)) + _SLACK
    leaves: list[tuple[int, int]] = []
    todo = [(0, 0)]
    while todo or leaves:
        if leaves and (not todo or len(leaves) * LEAF * LEAF > _PAIRS):
            yield from _leaf_pairs(a, b, leaves, cosine)
            leaves = []
            continue
        i, j = todo.pop()
        ci = a.children[i] if a.children[i] is not None else np.array([i])
        cj = b.children[j] if b.children[j] is not None else np.array([j])
        if a.children[i] is None and b.children[j] is None:
            leaves.append((i, j))
            continue
        centers_a, centers_b = np.array(a.center), np.array(b.center)
        radius_a, radius_b = np.array(a.radius), np.array(b.radius)
        far = np.sqrt(np.maximum(0, 2 - 2 * (a.x[centers_a[ci]] @ b.x[centers_b[cj]].T)))
        u, v = np.nonzero(far <= radius_a[ci][:, None] + radius_b[cj][None] + reach)
        u, v = ci[u], cj[v]
        if a is b and i == j:
            u, v = u[u <= v], v[u <= v]
        inner = np.array([a.children[k] is not None for k in u], bool) | np.array([b.children[k] is not None for k in v], bool)
        todo += zip(u[inner].tolist(), v[inner].tolist())
        leaves += zip(u[~inner].tolist(), v[~inner].tolist())


def _leaf_pairs(a: CoverTree, b: CoverTree, leaves: list[tuple[int, int]], cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    big = [(i, j) for i, j in leaves if len(a.points[i]) * len(b.points[j]) > LEAF * LEAF]
    for i, j in big:  # a leaf of equal vectors may be large: block by block
        for lo in range(0, len(a.points[i]), 512):
            # a leaf with itself: earlier slices have met this one
            p, q = a.points[i][lo : lo + 512], b.points[j][lo if a is b and i == j else 0 :]
            u, v = np.nonzero(a.x[p] @ b.x[q].T >= cosine)
            yield from _once(a is b, p[u], q[v])
    small = [(i, j) for i, j in leaves if len(a.points[i]) * len(b.points[j]) <= LEAF * LEAF]
    for lo in range(0, len(small), _PAIRS // LEAF):
        part = small[lo : lo + _PAIRS // LEAF]
        left, right = [a.points[i] for i, _ in part], [b.points[j] for _, j in part]
        na, nb = np.array([len(p) for p in left]), np.array([len(p) for p in right])
        pair, m, n = _cross(na, nb)
        p = np.concatenate(left)[(np.cumsum(na) - na)[pair] + m]
        q = np.concatenate(right)[(np.cumsum(nb) - nb)[pair] + n]
        for at in range(0, len(p), _PAIRS):
            u, v = p[at : at + _PAIRS], q[at : at + _PAIRS]
            near = np.einsum("ij,ij->i", a.x[u], b.x[v]) >= cosine
            yield from _once(a is b, u[near], v[near])


def _once(same: bool, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Within one tree a node pair is visited in one order only, but a node with itself holds each pair twice."""
    if same:
        low, high = np.minimum(u, v), np.maximum(u, v)
        code = np.unique(low[low != high].astype(np.int64) * (1 << 32) + high[low != high])
        u, v = code >> 32, code & ((1 << 32) - 1)
    if len(u):
        yield u, v


class Merger:
    """Union-find over few roots, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        p, q = self.root[u], self.root[v]
        differ = p != q
        if not differ.any():
            return
        pairs = np.unique(np.stack((p[differ], q[differ]), 1), axis=0)
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            while parent.get(k, k) != k:
                parent[k] = parent.get(parent[k], parent[k])
                k = parent[k]
            return k

        for s, t in pairs.tolist():
            s, t = find(s), find(t)
            if s != t:
                parent[max(s, t)] = min(s, t)
        to = np.arange(len(self.root))
        for k in parent:
            to[k] = find(k)
        self.root = to[self.root]
