"""Numpy geometry of one image: triangulation, components, refits. Small helpers for the Spark operators."""

from __future__ import annotations

import numpy as np


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edges (i < j) of the Delaunay triangulation, by incremental insertion.

    The outside is one vertex at infinity (-1), so hull edges are exact. A
    repeated point has no edges; fewer than three points, or points on one line, give none.
    """
    none = np.zeros((0, 2), np.int64)
    n = len(x)
    if n < 3:
        return none
    x, y = x - x.mean(), y - y.mean()
    lift = x * x + y * y
    a = 0
    apart = np.flatnonzero((x != x[a]) | (y != y[a]))
    if not len(apart):
        return none
    b = int(apart[0])
    turn = (x[b] - x[a]) * (y - y[a]) - (y[b] - y[a]) * (x - x[a])
    size = max(float(np.abs(turn).max()), 1e-300)
    off = np.flatnonzero(np.abs(turn) > 1e-12 * size)
    if size < 1e-9 or not len(off):
        return none
    c = int(off[0])
    if turn[c] < 0:
        a, b = b, a
    tri = np.array([[a, b, c], [b, a, -1], [c, b, -1], [a, c, -1]])
    seen = {(float(x[i]), float(y[i])) for i in (a, b, c)}
    for p in range(n):
        if p in (a, b, c) or (float(x[p]), float(y[p])) in seen:
            continue
        seen.add((float(x[p]), float(y[p])))
        i, j, k = tri.T
        px, py = x[p], y[p]
        ix, iy, jx, jy = x[i] - px, y[i] - py, x[j] - px, y[j] - py
        side = ix * jy - iy * jx
        kx, ky = x[k] - px, y[k] - py
        inside = (ix * ix + iy * iy) * (jx * ky - jy * kx) - (jx * jx + jy * jy) * (ix * ky - iy * kx) + (kx * kx + ky * ky) * side
        between = (side == 0) & (ix * jx + iy * jy < 0)
        bad = np.where(k < 0, (side > 0) | between, inside > 0)
        hole = tri[bad]
        sides = np.concatenate([hole[:, [0, 1]], hole[:, [1, 2]], hole[:, [2, 0]]])
        code = (sides[:, 0] + 1) * (n + 1) + sides[:, 1] + 1
        back = (sides[:, 1] + 1) * (n + 1) + sides[:, 0] + 1
        rim = sides[~np.isin(code, back)]
        new = np.column_stack([rim, np.full(len(rim), p)])
        # the vertex at infinity stands last
        first, second = new[:, 0] < 0, new[:, 1] < 0
        new[first] = new[first][:, [1, 2, 0]]
        new[second] = new[second][:, [2, 0, 1]]
        tri = np.concatenate([tri[~bad], new])
    real = tri[tri[:, 2] >= 0]
    edges = np.sort(np.concatenate([real[:, [0, 1]], real[:, [1, 2]], real[:, [2, 0]]]), axis=1)
    return np.unique(edges, axis=0)


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each vertex's connected component, by pointer jumping over whole arrays."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def greedy_by_weight(i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Survivors when of each close pair the lighter goes, heaviest pairs first (equal weights: j goes)."""
    alive = np.ones(len(weight), bool)
    for k in np.argsort(-np.maximum(weight[i], weight[j]), kind="stable"):
        a, b = i[k], j[k]
        if alive[a] and alive[b]:
            alive[b if weight[a] >= weight[b] else a] = False
    return alive


def close_pairs(x: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one image within ``radius``, by a sweep over sorted x."""
    order = np.argsort(x, kind="stable")
    sx = x[order]
    end = np.searchsorted(sx, sx + radius, side="right")
    n = end - np.arange(len(sx)) - 1
    a = np.repeat(np.arange(len(sx)), n)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    i, j = order[a], order[b]
    near = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= radius * radius
    return np.minimum(i, j)[near], np.maximum(i, j)[near]


def near_candidates(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, squared distance): for each a its ``most`` nearest b closer than ``reach``, ties by b; only points of neighbouring strips are compared."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(ax) or not len(bx) or not reach > 0:
        return none
    order = np.argsort(bx, kind="stable")
    lo, hi = np.searchsorted(bx[order], ax - reach), np.searchsorted(bx[order], ax + reach, side="right")
    parts = []
    # a million comparisons at once, whatever the image holds
    step = max(1, int(1e6 // max(1, (hi - lo).max())))
    for s in range(0, len(ax), step):
        n = (hi - lo)[s : s + step]
        a = np.repeat(np.arange(s, s + len(n)), n)
        b = order[np.repeat(lo[s : s + step], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
        d = (ax[a] - bx[b]) ** 2 + (ay[a] - by[b]) ** 2
        near = d < reach * reach
        a, b, d = a[near], b[near], d[near]
        by_dist = np.lexsort((b, d, a))
        a, b, d = a[by_dist], b[by_dist], d[by_dist]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        parts.append((a[rank < most], b[rank < most], d[rank < most]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else none
