"""Assignment of points to points: the exact solutions of `graph` without making all pairs within the radius.

Only short pairs are listed at first. A solution gives each row and column a price, and a pair left out can better it
only if it is shorter than the difference of its two prices; such pairs are looked for at every distance up to the
radius, and the solution is made anew until none is left. That proves it for all pairs, whatever was listed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.operators.forests import connected_components
from grovekit.operators.graph import Sparse
from grovekit.operators.spatial import near_join
from grovekit.session import cut, union_all

c = F.col
XY = ("id", "x", "y")
#: pairs listed at first: for each point, and in any case
PAIRS_EACH, PAIRS_LEAST = 3, 200_000
#: pairs that a task takes, whole components together; more where one component is larger
TASK_PAIRS = 50_000
#: pairs whose components one task finds, being numbers only
LINKED_PAIRS = 3_000_000
HALVINGS = 10
ROUNDS_MOST = 100


def _points(df: DataFrame, cols: tuple[str, str, str]) -> DataFrame:
    return df.select(*[c(k).alias(n) for k, n in zip(cols, XY)]).where("id is not null and x is not null and y is not null")


def _steps(a: DataFrame, b: DataFrame, radius: float) -> list[float]:
    """Distances that double up to the radius; the first is the longest within which few pairs are expected, by the
    products of counts in grid cells."""
    fine = radius / 2**HALVINGS
    cell = lambda df, n, m: df.select(F.floor(c("x") / fine).alias("i"), F.floor(c("y") / fine).alias("j"), F.lit(n).alias("n"), F.lit(m).alias("m"))
    g = cell(a, 1, 0).unionByName(cell(b, 0, 1)).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(c("i") / 2**k).alias("i"), F.floor(c("j") / 2**k).alias("j")) for k in range(HALVINGS + 1)])).alias("v")
    g = g.select(level, "n", "m").groupBy("v").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    got = {r["k"]: r for r in g.groupBy("v.k").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(c("n").cast("double") * c("m") * np.pi).alias("pairs")).collect()}
    first = next((k for k in range(HALVINGS, 0, -1) if k in got and got[k]["pairs"] <= max(PAIRS_LEAST, PAIRS_EACH * (got[k]["n"] + got[k]["m"]))), 0)
    return [radius / 2**k for k in range(HALVINGS - first, -1, -1)]


def _by_component(edges: DataFrame, task, schema: str) -> DataFrame:
    """Results of the task over parts of the pairs, none of which divides a component. The ends are linked by their
    hashes: should two be equal, that only joins two components."""
    parts = -(-edges.count() // TASK_PAIRS)
    part = F.lit(0)
    if parts > 1:
        edges = edges.withColumn("a", F.xxhash64(F.lit("L"), "l"))
        root = connected_components(edges.select("a", F.xxhash64(F.lit("R"), "r").alias("b")), LINKED_PAIRS, LINKED_PAIRS)
        edges, part = edges.join(root.select(c("item").alias("a"), "root"), "a"), F.pmod(F.xxhash64("root"), F.lit(parts))
    return cut(edges.withColumn("part", part).groupBy("part").applyInPandas(lambda pdf: task(pdf), schema))


def _both(rows: dict, cols: dict) -> pd.DataFrame:
    """Results of the rows (l not null) and of the columns (l null) of a component in one table."""
    one = lambda d: pd.DataFrame({k: pd.Series(v, dtype=object) if k in ("l", "r") else v for k, v in d.items()})
    return pd.concat([one(rows), one(cols)], ignore_index=True)


def _solve(slots: int, penalty: float, out: float):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, l = np.unique(pdf["l"].to_numpy(), return_inverse=True)
        cols, r = np.unique(pdf["r"].to_numpy(), return_inverse=True)
        s, name = Sparse(l, r, pdf["d"].to_numpy(), slots, penalty, out), cols.tolist()
        return _both({"l": rows.tolist(), "r": [name[j] if j >= 0 else None for j in s.at], "paid": s.paid, "price": s.u}, {"l": [None] * len(name), "r": name, "paid": 0.0, "price": s.v})

    return task


def _shorter(rows: DataFrame, cols: DataFrame, steps: list[float], top: float, low: float, tol: float, out: float) -> DataFrame:
    """(l, r, d) of pairs beyond steps[0] that are shorter than u - v by tol; top and low bound u and v."""
    found = []
    for near, far in zip(steps, steps[1:]):
        p = near_join(rows.where(c("u") - low > near), cols.where(top - c("v") > near), XY, XY, far, ("u",), ("v",))
        found.append(p.where((c("d") > near) & (c("d") < c("a_u") - c("b_v") - tol) & (c("d") < out)).select(c("a_id").alias("l"), c("b_id").alias("r"), "d"))
    return union_all(found)


def _bounds(rows: DataFrame, cols: DataFrame) -> tuple[float, float]:
    return rows.agg(F.max("u")).first()[0], cols.agg(F.min("v")).first()[0]


def _priced(a: DataFrame, b: DataFrame, steps: list[float], slots: int, penalty: float, out: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cols, listed): rows (id, x, y, r, paid, u) with r null where out, cols (id, x, y, v), and the listed pairs
    (l, r, d). The prices u and v hold for all pairs up to the last step that cost less than `out`."""
    kind, tol = [df.schema["id"].dataType.simpleString() for df in (a, b)], 1e-9 + 1e-14 * out
    listed = cut(near_join(a, b, XY, XY, steps[0]).where(c("d") < out).select(c("a_id").alias("l"), c("b_id").alias("r"), "d"))
    for _ in range(ROUNDS_MOST):
        s = _by_component(listed, _solve(slots, penalty, out), f"l {kind[0]}, r {kind[1]}, paid double, price double")
        rows, cols = s.where("l is not null").select(c("l").alias("id"), "r", "paid", c("price").alias("u")), s.where("l is null").select(c("r").alias("id"), c("price").alias("v"))
        rows = cut(a.join(rows, "id", "left").withColumn("u", F.coalesce("u", F.lit(float(out)))))
        cols = cut(b.join(cols, "id", "left").withColumn("v", F.coalesce("v", F.lit(0.0))))
        at, more = 0, None
        if len(steps) > 1 and not rows.isEmpty() and not cols.isEmpty():
            top, low = _bounds(rows, cols)
            open_ = lambda df, reach: df.agg(*[F.avg((reach > d).cast("double")) for d in steps]).first()
            share, pairs = [x * y for x, y in zip(open_(rows, c("u") - low), open_(cols, top - c("v")))], listed.count()
            while at < len(steps) - 1 and more is None:
                # as many steps at once as are expected to list half as many pairs again
                to = next((k for k in range(len(steps) - 1, at + 1, -1) if share[at] * (steps[k] / steps[0]) ** 2 <= 0.5), at + 1)
                if share[at]:
                    found = cut(_shorter(rows, cols, steps[at : to + 1], top, low, tol, out).join(listed.select("l", "r"), ["l", "r"], "left_anti"))
                    more = None if found.isEmpty() else found
                at = to
        if more is None:
            return rows, cols, listed
        listed = cut(listed.unionByName(more))
    raise RuntimeError("the prices did not settle")


def _reach(s: Sparse, margin: list[float]) -> tuple[list[float], list[float]]:
    """Of each column: how much a pair left out may cost to matter that starts at one of its rows, and that ends in it."""
    m = len(s.v)
    own = [max((margin[i] for i in h), default=0.0) for h in s.held]
    onward, back = [[] for _ in range(m)], [[] for _ in range(m)]
    for i, edges in enumerate(s.adj):
        for j, x in edges:
            if j != s.at[i]:
                r = max(x + s.v[j] - s.u[i], 0.0)
                onward[s.at[i]].append((j, r))
                back[j].append((s.at[i], r))
    got = []
    for need, arcs in (([max(x, f) for x, f in zip(own, s.full)], onward), (own, back)):
        need = [*need]
        heap = [(-d, j) for j, d in enumerate(need) if d > 0]
        heapq.heapify(heap)
        while heap:
            d, j = heapq.heappop(heap)
            if -d < need[j]:
                continue
            for k, r in arcs[j]:
                if -d - r > need[k]:
                    need[k] = -d - r
                    heapq.heappush(heap, (d + r, k))
        got.append(need)
    return got[0], got[1]


def _weigh(slots: int, penalty: float, out: float):
    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, l = np.unique(pdf["l"].to_numpy(), return_inverse=True)
        cols, r = np.unique(pdf["r"].to_numpy(), return_inverse=True)
        at, u, v, entry = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows)), np.zeros(len(cols)), np.zeros(len(cols))
        at[l], u[l], v[r], entry[r] = np.searchsorted(cols, pdf["at"].to_numpy()), pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["entry"].fillna(np.inf).to_numpy()
        s = Sparse(l, r, pdf["d"].to_numpy(), slots, penalty, out, (at.tolist(), u.tolist(), v.tolist()))
        margin = s.margins(entry.tolist())
        ahead, behind = _reach(s, margin)
        return _both(
            {"l": rows.tolist(), "r": cols[at].tolist(), "value": margin, "reach": [ahead[j] for j in s.at]},
            {"l": [None] * len(cols), "r": cols.tolist(), "value": s.full, "reach": behind},
        )

    return task


def _margins(rows: DataFrame, cols: DataFrame, listed: DataFrame, steps: list[float], slots: int, penalty: float, out: float) -> DataFrame:
    """(l, r, margin) of a solution of _priced: what the best solution without the row's choice costs more.

    The exchanges of rows with a place need pairs only that cost, over the prices, less than a margin; those not yet
    listed are added until there is none. A row that is out may come in at any column near it, at the column's price
    and what it costs to make room there.
    """
    kind = [dict(listed.dtypes)[k] for k in ("l", "r")]
    inside, outside = rows.where("r is not null"), rows.where("r is null")
    tol = 1e-9 + 1e-14 * out
    for _ in range(ROUNDS_MOST):
        entry = listed.join(outside.select(c("id").alias("l")).distinct(), "l", "left_semi").groupBy("r").agg(F.min("d").alias("entry"))
        e = listed.join(inside.select(c("id").alias("l"), c("r").alias("at"), "u").distinct(), "l").join(cols.select(c("id").alias("r"), "v").distinct(), "r")
        e = cut(e.join(entry, "r", "left").withColumn("entry", c("entry") + c("v") - out))
        s = _by_component(e, _weigh(slots, penalty, out), f"l {kind[0]}, r {kind[1]}, value double, reach double")
        of_row, of_col = s.where("l is not null").select(c("l").alias("id"), c("value").alias("margin"), "reach"), s.where("l is null").select(c("r").alias("id"), c("value").alias("room"), "reach")
        wide = cols.join(of_col, "id", "left").select(*XY, c("v").alias("price"), (c("v") - F.coalesce("reach", F.lit(0.0))).alias("v"), F.coalesce("room", F.lit(0.0)).alias("room"))
        wide, more = cut(wide), []
        if len(steps) > 1:
            for part in (outside, inside.join(of_row, "id", "left").withColumn("u", c("u") + F.coalesce("reach", F.lit(0.0)))):
                top, low = _bounds(part, wide)
                if top is not None:
                    more.append(_shorter(part, wide, steps, top, low, tol, out))
        found = cut(union_all(more).join(listed.select("l", "r"), ["l", "r"], "left_anti")) if more else None
        if found is None or found.isEmpty():
            break
        listed = cut(listed.unionByName(found))
    else:
        raise RuntimeError("the margins did not settle")
    stay = inside.join(of_row, "id").select(c("id").alias("l"), "r", "margin").distinct()
    come = _cheapest(outside.select(*XY), wide.select(*XY, (c("price") + c("room")).alias("w")), steps, out)
    return stay.unionByName(come.select(c("id").alias("l"), F.lit(None).cast(kind[1]).alias("r"), F.greatest(c("least") - out, F.lit(0.0)).alias("margin")))


def _cheapest(rows: DataFrame, cols: DataFrame, steps: list[float], out: float) -> DataFrame:
    """(id, least): least distance and w together of any column up to the last step and under `out` away.

    With each step only rows stay that a farther column can better, and only such columns.
    """
    open_, done = rows.withColumn("least", F.lit(None).cast("double")), []
    low, near = cols.agg(F.min("w")).first()[0], -1.0
    for far in steps:
        calm = c("least") <= out + near / 2
        parts = [(open_.where("least is null"), None)]
        tops = open_.agg(F.max(F.when(calm, c("least"))), F.max(F.when(~calm, c("least")))).first()
        parts += [(open_.where(p), t) for p, t in zip((calm, ~calm), tops) if t is not None]
        p = union_all([near_join(r, cols if t is None else cols.where(c("w") + near < t), XY, XY, far, (), ("w",)) for r, t in parts])
        p = p.where((c("d") > near) & (c("d") < out)).groupBy(c("a_id").alias("id")).agg(F.min(c("d") + c("b_w")).alias("__w"))
        got = cut(open_.join(p, "id", "left").withColumn("least", F.least("least", "__w")).drop("__w"))
        settled = F.coalesce(c("least") <= far + low, F.lit(False))
        done.append(got.where(settled | c("least").isNotNull()) if far == steps[-1] else got.where(settled))
        open_, near = got.where(~settled), far
    return union_all(done).groupBy("id").agg(F.min("least").alias("least"))


def optimal_near(a: DataFrame, b: DataFrame, a_cols: tuple[str, str, str], b_cols: tuple[str, str, str], radius: float) -> DataFrame:
    """(l, r, cost, exact) as graph.optimal_pairs of all pairs at most `radius` apart; cols are (id, x, y)."""
    a, b = _points(a, a_cols), _points(b, b_cols)
    n, m = a.count(), b.count()
    if n > m:
        return optimal_near(b, a, XY, XY, radius).select(c("r").alias("l"), c("l").alias("r"), "cost", "exact")
    # no row stays out for the sake of cost, as in graph
    rows, _, _ = _priced(a, b, _steps(a, b, radius), 1, 0.0, 2 * (n + 1) * radius + 1)
    return rows.where("r is not null").select(c("id").cast("string").alias("l"), c("r").cast("string").alias("r"), c("paid").alias("cost"), F.lit(True).alias("exact"))


def capacity_near(a: DataFrame, b: DataFrame, a_cols: tuple[str, str, str], b_cols: tuple[str, str, str], radius: float, slots: int = 8, penalty: float = 1.0, null: float = 10.0) -> DataFrame:
    """(l, r, margin) as graph.capacity_pairs of all pairs at most `radius` apart; cols are (id, x, y)."""
    a, b, radius = _points(a, a_cols), _points(b, b_cols), min(radius, null)
    steps = _steps(a, b, radius)
    m = _margins(*_priced(a, b, steps, slots, penalty, null), steps, slots, penalty, null)
    return m.select(c("l").cast("string").alias("l"), c("r").cast("string").alias("r"), "margin")
