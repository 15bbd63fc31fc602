"""Suppression, components and assignment on neighbour pairs."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.operators.forests import connected_components
from grovekit.operators.spatial import both_ways, near_pairs
from grovekit.session import cut

c = F.col
ROUNDS_MOST = 200


def greedy_suppress(df: DataFrame, cols: tuple[str, str, str], priority: list[Column], radius: Column, most: float, by: str = "self", strict: bool = False, always: Column | None = None) -> DataFrame:
    """Ids kept by going through the items in priority order and dropping each that is too near a kept one.

    by: whose radius counts, 'self' (the later item's) or 'dominator' (the kept one's); strict: < instead of <=;
    `most` bounds the radius; items where `always` is true are kept whatever is near. Ties of priority go by id.
    Only neighbour pairs take part, in rounds: an item without an undecided stronger neighbour is kept and drops
    its weaker ones, which is the same as the sequential result.
    """
    pr = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)], c(cols[0]).alias("pid")).alias("pr")
    s = df.select(*[c(x) for x in cols], pr, radius.alias("rad"), (always if always is not None else F.lit(False)).alias("always"))
    keep = ("pr", "rad", "always")
    p = both_ways(near_pairs(s, cols, most, keep), keep).where((c("a_pr") < c("b_pr")) & ~c("b_always"))
    r = c("b_rad") if by == "self" else c("a_rad")
    p = p.where((c("d") < r) if strict else (c("d") <= r))
    pairs, dropped = cut(p.select(c("a_id").alias("hi"), c("b_id").alias("lo"))), None
    for _ in range(ROUNDS_MOST):
        if pairs.isEmpty():
            break
        kept = pairs.select("hi").distinct().join(pairs.select(c("lo").alias("hi")).distinct(), "hi", "left_anti")
        gone = cut(pairs.join(kept, "hi", "left_semi").select(c("lo").alias("id")).distinct())
        dropped = gone if dropped is None else cut(dropped.unionByName(gone))
        left = pairs.join(gone.select(c("id").alias("lo")), "lo", "left_anti").join(gone.select(c("id").alias("hi")), "hi", "left_anti")
        pairs = cut(left)
    else:
        raise RuntimeError("suppression did not settle")
    ids = s.select(c(cols[0]).alias("id"))
    return ids if dropped is None else ids.join(dropped, "id", "left_anti")


def components(edges: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """(id, component): smallest id linked directly or not, by union-find in edge partitions (forests). Ids are
    strings or whole numbers. Loops and null ends are left out."""
    label = connected_components(edges.select(c(a).alias("a"), c(b).alias("b")))
    head = label.groupBy("root").agg(F.min("item").alias("component"))
    return label.join(head, "root").select(c("item").alias("id"), "component")


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row of a cost matrix with at least as many columns as rows, by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            free = np.flatnonzero(~used[1:]) + 1
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[1:][~used[1:]] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


class Sparse:
    """Rows to columns at least cost over edges only: a column takes up to `slots` rows, the k-th at k * penalty more,
    and a row without a column costs `out`. Rows enter one by one along shortest augmenting paths, so the result is
    optimal at every size; u and v are its prices, by which each row has its cheapest choice. `settled` takes over a
    solution made before: the column (-1 where out) and price of each row, and the price of each column."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, slots: int, penalty: float, out: float, settled: tuple[list[int], list[float], list[float]] | None = None):
        n, m = int(rows.max()) + 1, int(cols.max()) + 1
        self.adj: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for i, j, x in zip(rows.tolist(), cols.tolist(), cost.tolist()):
            self.adj[i].append((j, x))
        self.slots, self.penalty, self.out = slots, float(penalty), float(out)
        self.v, self.u, self.at, self.paid = [0.0] * m, [self.out] * n, [-1] * n, [self.out] * n
        self.held: list[set[int]] = [set() for _ in range(m)]
        if settled is not None:
            self.at, self.u, self.v = settled
            for i, j in enumerate(self.at):
                if j >= 0:
                    self.held[j].add(i)
            return
        for i in range(n):
            self._enter(i)

    def _room(self, j: int) -> float:
        """What a further row adds to column j over its price."""
        return self.penalty * len(self.held[j]) - self.v[j] if len(self.held[j]) < self.slots else np.inf

    def _relax(self, i: int, d: float, most: float, dist: dict, way: dict, heap: list) -> None:
        u, v = self.u[i], self.v
        for j, x in self.adj[i]:
            if (e := d + max(x + v[j] - u, 0.0)) < most and e < dist.get(j, np.inf) and j != self.at[i]:
                dist[j], way[j] = e, (i, x)
                heapq.heappush(heap, (e, j))

    def _enter(self, i: int) -> None:
        v, u = self.v, self.u
        u[i] = min(self.out, min((x + v[j] for j, x in self.adj[i]), default=self.out))
        dist, way, heap, seen = {}, {}, [], []
        best, end, last = self.out - u[i], i, -1  # the row that goes out, or the column that takes one more
        self._relax(i, 0.0, best, dist, way, heap)
        while heap:
            d, j = heapq.heappop(heap)
            if d > dist[j]:
                continue
            if d >= best:
                break
            seen.append((d, j))
            if (e := d + max(self._room(j), 0.0)) < best:
                best, end, last = e, -1, j
            for k in sorted(self.held[j]):
                if (e := d + max(self.out - u[k], 0.0)) < best:
                    best, end, last = e, k, j
            for k in self.held[j]:
                self._relax(k, d, best, dist, way, heap)
        u[i] += best
        for d, j in seen:
            if d < best:
                v[j] += best - d
                for k in self.held[j]:
                    u[k] += best - d
        if end == i:
            return
        if end >= 0:
            self.held[last].discard(end)
            self.at[end], self.paid[end] = -1, self.out
        while True:
            k, x = way[last]
            before = self.at[k]
            if before >= 0:
                self.held[before].discard(k)
            self.held[last].add(k)
            self.at[k], self.paid[k] = last, x
            if k == i:
                return
            last = before

    def margins(self, entry: list[float] | None = None) -> list[float]:
        """What the best solution without its choice costs more, of each row: the shortest way in the residual graph
        from the row back to its column, either over a place that becomes free elsewhere or by an exchange. `entry` is
        what it costs over the prices that some row beyond those given, being out, comes into each column."""
        n, m, inf = len(self.adj), len(self.v), np.inf
        out, free, back = [inf] * n, [inf] * m, [[] for _ in range(m)]
        for i, edges in enumerate(self.adj):
            for j, x in edges:
                if j != self.at[i]:
                    back[j].append((i, max(x + self.v[j] - self.u[i], 0.0)))
        # out: from a row to any end; the rows of a column share its value from there on
        full = [inf] * m
        heap = [(max(self._room(j), 0.0), j) for j in range(m) if len(self.held[j]) < self.slots]
        heap += [(max(self.out - self.u[i], 0.0), self.at[i]) for i in range(n) if self.at[i] >= 0]
        for i in range(n):
            if self.at[i] >= 0:
                out[i] = max(self.out - self.u[i], 0.0)
        heapq.heapify(heap)
        while heap:
            d, j = heapq.heappop(heap)
            if d >= full[j]:
                continue
            full[j] = d
            for i, r in back[j]:
                if d + r < out[i]:
                    out[i] = d + r
                    if self.at[i] >= 0:
                        heapq.heappush(heap, (d + r, self.at[i]))
        self.full = full
        # free: from any end to a column, by a place given up there or by rows that move
        heap = [(max(self.v[j] - self.penalty * (len(h) - 1), 0.0), j) for j, h in enumerate(self.held) if h]
        heap += [(max(x + self.v[j] - self.u[i], 0.0), j) for i in range(n) if self.at[i] < 0 for j, x in self.adj[i]]
        heap += [(max(d, 0.0), j) for j, d in enumerate(entry or ()) if d < inf]
        heapq.heapify(heap)
        while heap:
            d, j = heapq.heappop(heap)
            if d >= free[j]:
                continue
            free[j] = d
            for i in self.held[j]:
                for k, x in self.adj[i]:
                    if k != j and (e := d + max(x + self.v[k] - self.u[i], 0.0)) < free[k]:
                        heapq.heappush(heap, (e, k))
        return [out[i] if self.at[i] < 0 else self._exchange(i, out[i] + free[self.at[i]]) for i in range(n)]

    def _exchange(self, i: int, most: float) -> float:
        goal, dist, heap = self.at[i], {}, []
        self._relax(i, 0.0, most, dist, {}, heap)
        while heap:
            d, j = heapq.heappop(heap)
            if j == goal:
                return d
            if d > dist[j]:
                continue
            for k in self.held[j]:
                self._relax(k, d, most, dist, {}, heap)
        return most


def _sides(pdf: pd.DataFrame) -> tuple[list, np.ndarray, list, np.ndarray, np.ndarray]:
    (left, l), (right, r) = (np.unique(pdf[k].to_numpy(), return_inverse=True) for k in ("l", "r"))
    return left.tolist(), l, right.tolist(), r, pdf["cost"].to_numpy()


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    left, l, right, r, cost = _sides(pdf)
    # no row stays out for the sake of cost: that is dearer than all that one more pair can change
    out = 2 * (min(len(left), len(right)) + 1) * float(np.abs(cost).max()) + 1
    if len(left) <= len(right):
        s = Sparse(l, r, cost, 1, 0.0, out)
        rows = [(left[i], right[j], s.paid[i], True) for i, j in enumerate(s.at) if j >= 0]
    else:
        s = Sparse(r, l, cost, 1, 0.0, out)
        rows = [(left[j], right[i], s.paid[i], True) for i, j in enumerate(s.at) if j >= 0]
    return pd.DataFrame(rows, columns=["l", "r", "cost", "exact"])


def optimal_pairs(edges: DataFrame, left: str, right: str, cost: str) -> DataFrame:
    """(l, r, cost, exact): one-to-one pairs, as many as possible, then of least total cost.

    Solved per component of the bipartite graph in one task, over its edges only; exact at every size.
    """
    e = cut(edges.select(c(left).cast("string").alias("l"), c(right).cast("string").alias("r"), c(cost).cast("double").alias("cost")).where("l is not null and r is not null and cost is not null"))
    comp = components(e.select(F.concat(F.lit("L"), "l").alias("a_id"), F.concat(F.lit("R"), "r").alias("b_id")))
    e = e.join(comp.select(F.substring("id", 2, 1000).alias("l"), "component", F.substring("id", 1, 1).alias("side")).where("side = 'L'").drop("side"), "l")
    return e.groupBy("component").applyInPandas(lambda pdf: _assign(pdf), "l string, r string, cost double, exact boolean")


def _capacity(slots: int, penalty: float, null: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rec, l, crown, r, cost = _sides(pdf)
        s = Sparse(l, r, cost, slots, penalty, null)
        rows = [(rec[i], crown[j] if j >= 0 else None, margin) for i, (j, margin) in enumerate(zip(s.at, s.margins()))]
        return pd.DataFrame(rows, columns=["l", "r", "margin"])

    return solve


def capacity_pairs(edges: DataFrame, left: str, right: str, cost: str, slots: int = 8, penalty: float = 1.0, null: float = 10.0) -> DataFrame:
    """(l, r, margin): each left item to one right item or none (r null); a right item takes up to `slots`, each
    further one at a higher penalty. margin is what the next best solution without the choice costs more. Both are
    exact at every size; a component is solved in one task, over its edges only."""
    e = cut(edges.select(c(left).cast("string").alias("l"), c(right).cast("string").alias("r"), c(cost).cast("double").alias("cost")).where(c("cost") < null).where("l is not null and r is not null"))
    comp = components(e.select(F.concat(F.lit("L"), "l").alias("a_id"), F.concat(F.lit("R"), "r").alias("b_id")))
    e = e.join(comp.where(c("id").startswith("L")).select(F.substring("id", 2, 1000).alias("l"), "component"), "l")
    return e.groupBy("component").applyInPandas(_capacity(slots, penalty, null), "l string, r string, margin double")
