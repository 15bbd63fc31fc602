"""Spatial joins by equi-joins on grid cells: ranges, nearest, containment, segments, boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions.geo import clip_convex, in_rings, ring_area, segment_distance
from grovekit.session import cut, union_all

c = F.col
ROUNDS_MOST = 40


def distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.sqrt((c(ax) - c(bx)) * (c(ax) - c(bx)) + (c(ay) - c(by)) * (c(ay) - c(by)))


def _cells_near(x: Column, y: Column, size: float) -> Column:
    """The 3 x 3 cells around a point."""
    i, j = F.floor(x / size), F.floor(y / size)
    return F.explode(F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))


def near_join(a: DataFrame, b: DataFrame, a_cols: tuple[str, str, str], b_cols: tuple[str, str, str], radius: float, a_keep: Sequence[str] = (), b_keep: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id, d, ax, ay, bx, by) of all pairs at most `radius` apart; cols are (id, x, y). Null positions pair
    with nothing. Columns of a_keep and b_keep come along as a_<name>, b_<name>, so no pair is joined again by id.

    Cells have the radius as side; b goes to the nine cells around it. AQE splits a crowded cell.
    """
    side = lambda df, cols, keep, p: df.select(c(cols[0]).alias(f"{p}_id"), c(cols[1]).alias(f"{p}x"), c(cols[2]).alias(f"{p}y"), *[c(k).alias(f"{p}_{k}") for k in keep]).where(c(f"{p}x").isNotNull() & c(f"{p}y").isNotNull())
    l, r = side(a, a_cols, a_keep, "a"), side(b, b_cols, b_keep, "b")
    l = l.withColumn("i", F.floor(c("ax") / radius)).withColumn("j", F.floor(c("ay") / radius))
    r = r.select("*", _cells_near(c("bx"), c("by"), radius).alias("cell")).select(*r.columns, "cell.i", "cell.j")
    return l.join(r, ["i", "j"]).withColumn("d", distance("ax", "ay", "bx", "by")).where(c("d") <= radius).drop("i", "j")


def near_pairs(df: DataFrame, cols: tuple[str, str, str], radius: float, keep: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id, d, a_<keep>, b_<keep>) with a_id < b_id of pairs of one table at most `radius` apart.

    A row goes to its own cell and four of its neighbours only, so each pair meets once.
    """
    p = df.where(c(cols[0]).isNotNull() & c(cols[1]).isNotNull() & c(cols[2]).isNotNull())
    p = p.select(F.struct(c(cols[0]).alias("__id"), c(cols[1]).alias("__x"), c(cols[2]).alias("__y"), *[c(k).alias(k) for k in keep]).alias("p"))
    i, j = F.floor(c("p.__x") / radius), F.floor(c("p.__y") / radius)
    l = p.select("p", i.alias("i"), j.alias("j"))
    half = F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j"), F.lit((a, b) == (0, 0)).alias("own")) for a, b in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    r = p.select(c("p").alias("q"), F.explode(half).alias("cell")).select("q", "cell.i", "cell.j", "cell.own")
    n = l.join(r, ["i", "j"]).where((c("p.__id") != c("q.__id")) & (~c("own") | (c("p.__id") < c("q.__id"))))
    n = n.withColumn("d", distance("p.__x", "p.__y", "q.__x", "q.__y")).where(c("d") <= radius)
    first = c("p.__id") < c("q.__id")
    n = n.select(F.when(first, c("p")).otherwise(c("q")).alias("a"), F.when(first, c("q")).otherwise(c("p")).alias("b"), "d")
    return n.select(c("a.__id").alias("a_id"), c("b.__id").alias("b_id"), "d", *[c(f"a.{k}").alias(f"a_{k}") for k in keep], *[c(f"b.{k}").alias(f"b_{k}") for k in keep])


def radius_pairs(df: DataFrame, cols: tuple[str, str, str], radius: float) -> DataFrame:
    """(a_id, b_id, d) with a_id < b_id of pairs at most `radius` apart."""
    return near_pairs(df, cols, radius)


def both_ways(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each pair of near_pairs in both directions, without a shuffle."""
    turn = lambda a, b: F.struct(c(f"{a}_id").alias("a_id"), c(f"{b}_id").alias("b_id"), c("d").alias("d"), *[c(f"{a}_{k}").alias(f"a_{k}") for k in keep], *[c(f"{b}_{k}").alias(f"b_{k}") for k in keep])
    return pairs.select(F.inline(F.array(turn("a", "b"), turn("b", "a"))))


def nearest_within(a: DataFrame, b: DataFrame, a_cols: tuple[str, str, str], b_cols: tuple[str, str, str], radius: float, strict: bool = False) -> DataFrame:
    """(a_id, b_id, d): the nearest b of each a, ties to the smallest id; an aggregate, so crowded cells combine early."""
    p = near_join(a, b, a_cols, b_cols, radius)
    if strict:
        p = p.where(c("d") < radius)
    return p.groupBy("a_id").agg(F.min(F.struct("d", "b_id")).alias("m")).select("a_id", c("m.b_id").alias("b_id"), c("m.d").alias("d"))


def without_near(a: DataFrame, a_cols: tuple[str, str, str], b: DataFrame, b_cols: tuple[str, str, str], radius: float) -> DataFrame:
    """Rows of a with no b at most `radius` away; rows without a position stay."""
    hit = near_join(a, b, a_cols, b_cols, radius).select(c("a_id").alias(a_cols[0])).distinct()
    return a.join(hit, a_cols[0], "left_anti")


def k_nearest(a: DataFrame, b: DataFrame, a_cols: tuple[str, str, str], b_cols: tuple[str, str, str], k: int, start: float, most: float, skip_self: bool = False) -> DataFrame:
    """(a_id, rank, b_id, d) of the k nearest b of each a within `most`, by growing rings.

    A point with k neighbours inside the ring is finished; only the others go to the doubled ring.
    """
    left, done, r = a, [], start
    for _ in range(ROUNDS_MOST):
        p = near_join(left, b, a_cols, b_cols, r)
        if skip_self:
            p = p.where(c("a_id") != c("b_id"))
        w = Window.partitionBy("a_id").orderBy("d", "b_id")
        got = p.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k).select("a_id", "rank", "b_id", "d")
        if r >= most:
            done.append(got)
            break
        got = cut(got)
        full = got.groupBy("a_id").agg(F.count("*").alias("n")).where(c("n") == k).select("a_id")
        done.append(got.join(full, "a_id", "left_semi"))
        left = cut(left.join(full.select(c("a_id").alias(a_cols[0])), a_cols[0], "left_anti"))
        if left.isEmpty():
            break
        r = min(r * 2, most)
    return union_all(done)


def _region_cells(regions: DataFrame, rid: str, rings: str, size: float, extra: list[str]) -> DataFrame:
    """Regions in every cell that the bounding box of their first ring touches."""
    xs, ys = F.transform(c(rings)[0], lambda p: p["x"]), F.transform(c(rings)[0], lambda p: p["y"])
    lo = lambda v: F.floor(F.array_min(v) / size)
    hi = lambda v: F.floor(F.array_max(v) / size)
    r = regions.select(c(rid).alias("region_id"), c(rings).alias("rings"), *extra, lo(xs).alias("i0"), hi(xs).alias("i1"), lo(ys).alias("j0"), hi(ys).alias("j1"))
    r = r.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1")))
    return r.drop("i0", "i1", "j0", "j1")


def pip_join(points: DataFrame, p_cols: tuple[str, str, str], regions: DataFrame, rid: str, rings: str, size: float, policy: str = "all", order: str | None = None) -> DataFrame:
    """(p_id, region_id) of points in regions (odd-even over all rings).

    policy: all; smallest (by area of the outline, then id); first (by `order`, then id); unique (points in exactly
    one region). Candidates share a cell of `size`.
    """
    extra = [order] if order else []
    p = points.select(c(p_cols[0]).alias("p_id"), c(p_cols[1]).alias("px"), c(p_cols[2]).alias("py")).where("px is not null and py is not null")
    p = p.withColumn("i", F.floor(c("px") / size)).withColumn("j", F.floor(c("py") / size))
    hit = p.join(_region_cells(regions, rid, rings, size, extra), ["i", "j"]).where(in_rings(c("rings"), c("px"), c("py")))
    if policy == "all":
        return hit.select("p_id", "region_id")
    if policy == "unique":
        return hit.groupBy("p_id").agg(F.min("region_id").alias("region_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    key = F.abs(ring_area(c("rings")[0])) if policy == "smallest" else c(order)
    return hit.groupBy("p_id").agg(F.min(F.struct(key.alias("k"), "region_id")).alias("m")).select("p_id", c("m.region_id").alias("region_id"))


def segment_join(points: DataFrame, p_cols: tuple[str, str, str], segments: DataFrame, s_cols: tuple[str, str, str, str, str], most: float, size: float) -> DataFrame:
    """(p_id, seg_id, d) of segments at most `most` from a point; s_cols are (id, x1, y1, x2, y2)."""
    p = points.select(c(p_cols[0]).alias("p_id"), c(p_cols[1]).alias("px"), c(p_cols[2]).alias("py")).where("px is not null and py is not null")
    p = p.withColumn("i", F.floor(c("px") / size)).withColumn("j", F.floor(c("py") / size))
    s = segments.select(*[c(x).alias(n) for x, n in zip(s_cols, ("seg_id", "x1", "y1", "x2", "y2"))])
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - most) / size), F.floor((F.greatest(a, b) + most) / size)))
    s = s.withColumn("i", span(c("x1"), c("x2"))).withColumn("j", span(c("y1"), c("y2")))
    d = segment_distance(c("px"), c("py"), c("x1"), c("y1"), c("x2"), c("y2"))
    return p.join(s, ["i", "j"]).withColumn("d", d).where(c("d") <= most).select("p_id", "seg_id", "d")


def nearest_segment(points: DataFrame, p_cols: tuple[str, str, str], segments: DataFrame, s_cols: tuple[str, str, str, str, str], most: float, size: float) -> DataFrame:
    j = segment_join(points, p_cols, segments, s_cols, most, size)
    return j.groupBy("p_id").agg(F.min(F.struct("d", "seg_id")).alias("m")).select("p_id", c("m.seg_id").alias("seg_id"), c("m.d").alias("d"))


def box_overlaps(a: DataFrame, b: DataFrame, a_cols: tuple[str, ...], b_cols: tuple[str, ...], size: float, least: float = 0.25) -> DataFrame:
    """(a_id, b_id, area, a_share, b_share) of axis-aligned boxes that overlap; cols are (id, x0, y0, x1, y1)."""

    def cells(df: DataFrame, cols: tuple[str, ...], p: str) -> DataFrame:
        d = df.select(*[c(x).alias(f"{p}{n}") for x, n in zip(cols, ("_id", "x0", "y0", "x1", "y1"))])
        d = d.withColumn("i", F.explode(F.sequence(F.floor(c(f"{p}x0") / size), F.floor(c(f"{p}x1") / size))))
        return d.withColumn("j", F.explode(F.sequence(F.floor(c(f"{p}y0") / size), F.floor(c(f"{p}y1") / size))))

    from grovekit.functions.geo import box_overlap

    j = cells(a, a_cols, "a").join(cells(b, b_cols, "b"), ["i", "j"])
    # of the cells that both touch, only the one with the lower-left corner of the common box counts the pair
    own = (c("i") == F.floor(F.greatest("ax0", "bx0") / size)) & (c("j") == F.floor(F.greatest("ay0", "by0") / size))
    area = box_overlap(*[c(x) for x in ("ax0", "ay0", "ax1", "ay1", "bx0", "by0", "bx1", "by1")])
    j = j.where(own).withColumn("area", area).where(c("area") >= least)
    full = lambda p: (c(f"{p}x1") - c(f"{p}x0")) * (c(f"{p}y1") - c(f"{p}y0"))
    return j.select("a_id", "b_id", "area", (c("area") / full("a")).alias("a_share"), (c("area") / full("b")).alias("b_share"))


def convex_overlaps(pairs: DataFrame, a_id: str, b_id: str, a_ring: str, b_ring: str, least: float = 0.25) -> DataFrame:
    """(a_id, b_id, area) of candidate pairs of rings by clipping a to the convex, counter-clockwise b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, j, ra, rb in zip(pdf[a_id], pdf[b_id], pdf[a_ring], pdf[b_ring]):
                got = clip_convex([(p["x"], p["y"]) for p in ra], [(p["x"], p["y"]) for p in rb])
                s = abs(sum(got[k - 1][0] * got[k][1] - got[k][0] * got[k - 1][1] for k in range(len(got)))) / 2
                if s >= least:
                    out.append((i, j, s))
            yield pd.DataFrame(out, columns=[a_id, b_id, "area"])

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select(a_id, b_id, a_ring, b_ring).mapInPandas(run, f"`{a_id}` {kind[a_id]}, `{b_id}` {kind[b_id]}, area double")


def majority_share(overlaps: DataFrame, key: str, kind: str, area: str, whole: Column) -> DataFrame:
    """(key, kind, share): the kind with the largest summed area, its share of `whole` at most 1."""
    g = overlaps.groupBy(key, kind).agg(F.sum(area).alias("s"), F.max(whole).alias("w"))
    m = g.groupBy(key).agg(F.max(F.struct("s", kind, "w")).alias("m"))
    return m.select(key, c(f"m.{kind}").alias(kind), F.least(c("m.s") / c("m.w"), F.lit(1.0)).alias("share"))


def competition(df: DataFrame, cols: tuple[str, str, str], height: str, area: str, near: float = 25.0, far: float = 50.0) -> DataFrame:
    """Per item: neighbours within near and far, crown cover of both discs (at most 1), overlap and dominance."""
    s = df.select(*cols, c(height).alias("h"), c(area).alias("s"))
    p = both_ways(near_pairs(s, cols, far, ("h", "s")), ("h", "s")).select("a_id", "d", *[c(f"{x}_{k}").alias(f"{k}{x}") for k in "hs" for x in "ab"])
    n = c("d") <= near
    rad = lambda a: F.sqrt(F.greatest(c(a), F.lit(1e-6)) / math.pi)
    g = p.groupBy("a_id").agg(
        F.min("d").alias("nearest"),
        F.count(F.when(n, 1)).alias("n_near"),
        F.count("*").alias("n_far"),
        F.sum(F.when(n, c("sb"))).alias("s_near"),
        F.sum("sb").alias("s_far"),
        F.count(F.when(n & (rad("sa") + rad("sb") > c("d")), 1)).alias("n_over"),
        F.count(F.when(n & (c("hb") > c("ha")), 1)).alias("n_taller"),
    )
    base = s.select(c(cols[0]).alias("a_id")).join(g, "a_id", "left").fillna(0, ["n_near", "n_far", "s_near", "s_far", "n_over", "n_taller"])
    share = c("n_taller") / F.greatest(c("n_near"), F.lit(1))
    return base.select(
        c("a_id").alias("id"), "nearest", "n_near", "n_far",
        F.least(F.lit(1.0), c("s_near") / (math.pi * near * near)).alias("cover_near"),
        F.least(F.lit(1.0), c("s_far") / (math.pi * far * far)).alias("cover_far"),
        (c("n_over") / F.greatest(c("n_near"), F.lit(1))).alias("overlap"),
        F.when(c("n_near") == 0, "dominant").when(share <= 0.2, "dominant").when(share >= 0.7, "suppressed").otherwise("co-dominant").alias("dominance"),
    )
