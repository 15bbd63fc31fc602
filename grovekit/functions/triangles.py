"""Planar geometry in NumPy: ear clipping, point in triangle, bounding-volume hierarchies."""

from __future__ import annotations

import numpy as np


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return 0.5 * float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def ear_clip(ring) -> np.ndarray:
    """Triangles (n, 3, 2) that tile a simple ring. Repeated and collinear points are dropped; fewer than three
    proper corners give no triangle."""
    pts = np.asarray(ring, dtype=np.float64).reshape(-1, 2)
    if len(pts) > 1 and np.array_equal(pts[0], pts[-1]):
        pts = pts[:-1]
    if len(pts) > 1:
        pts = pts[np.any(pts != np.roll(pts, 1, axis=0), axis=1)]
    if len(pts) < 3:
        return np.empty((0, 3, 2))
    if signed_area(pts) < 0:
        pts = pts[::-1]
    left, out = list(range(len(pts))), []
    while len(left) > 3:
        n = len(left)
        for i in range(n):
            a, b, c = (pts[left[j % n]] for j in (i - 1, i, i + 1))
            turn = _cross(a, b, c)
            if turn == 0:
                del left[i]
                break
            if turn < 0:
                continue
            rest = pts[[left[j] for j in range(n) if j not in (i, (i - 1) % n, (i + 1) % n)]]
            inside = (_cross(a, b, rest) >= 0) & (_cross(b, c, rest) >= 0) & (_cross(c, a, rest) >= 0)
            corner = np.any(np.all(rest[:, None, :] == np.stack([a, b, c])[None], axis=2), axis=1)
            if not np.any(inside & ~corner):
                out.append((a, b, c))
                del left[i]
                break
        else:  # a ring that crosses itself: cut the next convex corner
            i = next((j for j in range(n) if _cross(*(pts[left[m % n]] for m in (j - 1, j, j + 1))) > 0), 0)
            out.append(tuple(pts[left[j % n]] for j in (i - 1, i, i + 1)))
            del left[i]
    if len(left) == 3 and _cross(*(pts[j] for j in left)) != 0:
        out.append(tuple(pts[j] for j in left))
    return np.array(out, dtype=np.float64).reshape(-1, 3, 2)


def in_triangles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Boolean (points, triangles): inside or on the border of counter-clockwise triangles."""
    q = p[:, None, :]
    a, b, c = tri[None, :, 0], tri[None, :, 1], tri[None, :, 2]
    return (_cross(a, b, q) >= 0) & (_cross(b, c, q) >= 0) & (_cross(c, a, q) >= 0)


class TopTree:
    """Upper levels of a hierarchy: half-spaces chosen at medians of a sample; a point falls into one leaf, a box
    into every leaf that it touches."""

    def __init__(self, sample: np.ndarray, per_leaf: int):
        self.axis, self.value, self.child = [0], [0.0], [[-1, -1]]
        self.weight: list[int] = []
        todo = [(0, sample)]
        while todo:
            node, pts = todo.pop()
            axis = int(np.argmax(np.ptp(pts, axis=0))) if len(pts) else 0
            mid = float(np.median(pts[:, axis])) if len(pts) else 0.0
            low = pts[:, axis] < mid
            if len(pts) <= per_leaf or not low.any():
                self.axis[node], self.child[node] = -1, [len(self.weight), 0]
                self.weight.append(len(pts))
                continue
            self.axis[node], self.value[node] = axis, mid
            for side, part in enumerate((pts[low], pts[~low])):
                self.child[node][side] = len(self.axis)
                self.axis.append(0), self.value.append(0.0), self.child.append([-1, -1])
                todo.append((self.child[node][side], part))
        self.axis, self.value, self.child = np.array(self.axis), np.array(self.value), np.array(self.child)

    def leaf_of(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), dtype=np.int64)
        while True:
            axis = self.axis[node]
            open_ = axis >= 0
            if not open_.any():
                return self.child[node, 0]
            i = np.flatnonzero(open_)
            right = p[i, axis[i]] >= self.value[node[i]]
            node[i] = self.child[node[i], right.astype(int)]

    def leaves_of(self, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box index, leaf) for boxes (n, 4): min x, min y, max x, max y."""
        who, node, done = np.arange(len(box)), np.zeros(len(box), dtype=np.int64), []
        while len(who):
            axis = self.axis[node]
            end = axis < 0
            done.append((who[end], self.child[node[end], 0]))
            who, node, axis = who[~end], node[~end], axis[~end]
            value = self.value[node]
            low, high = box[who, axis] < value, box[who, axis + 2] >= value
            who, node = np.concatenate([who[low], who[high]]), np.concatenate([self.child[node[low], 0], self.child[node[high], 1]])
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def hits(p: np.ndarray, tri: np.ndarray, leaf: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(point index, triangle index) of containments, by a hierarchy of boxes over the triangles."""
    out_p, out_t = [], []
    if len(p) and len(tri):
        lo, hi = tri.min(axis=1), tri.max(axis=1)
        mid = (lo + hi) / 2
        todo = [(np.arange(len(tri)), np.arange(len(p)))]
        while todo:
            t, q = todo.pop()
            b0, b1 = lo[t].min(axis=0), hi[t].max(axis=0)
            pq = p[q]
            q = q[(pq[:, 0] >= b0[0]) & (pq[:, 0] <= b1[0]) & (pq[:, 1] >= b0[1]) & (pq[:, 1] <= b1[1])]
            if not len(q):
                continue
            if len(t) <= leaf:
                a, b = np.nonzero(in_triangles(p[q], tri[t]))
                out_p.append(q[a])
                out_t.append(t[b])
                continue
            axis = int(np.argmax(b1 - b0))
            order = np.argpartition(mid[t, axis], len(t) // 2)
            todo += [(t[order[: len(t) // 2]], q), (t[order[len(t) // 2 :]], q)]
    if not out_p:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(out_p), np.concatenate(out_t)
