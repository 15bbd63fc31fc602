"""Point clouds, height cells and repeated surveys as DataFrame operators."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions.text import let
from grovekit.operators.forests import connected_components
from grovekit.operators.graph import components, optimal_pairs
from grovekit.operators.spatial import near_join, near_pairs, without_near
from grovekit.session import cut

c = F.col


# point clouds
def return_summary(df: DataFrame, key: str, z: str, is_veg: Column, is_building: Column, is_first: Column, is_multi: Column, sparse: int = 30, top_least: float = 2.0, cover_least: float = 0.25) -> DataFrame:
    """Per footprint, from mergeable sums: counts by class, heights over the lowest return, and a verdict.

    no_data never occurs here (a footprint without returns has no row); sparse below `sparse` returns; vegetation
    needs a share of 0.7 of the classified returns and woody canopy, at most 0.3 is building or structure.
    """
    v = F.when(is_veg, c(z))
    g = df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count(F.when(is_veg, 1)).alias("n_veg"),
        F.count(F.when(is_building, 1)).alias("n_building"),
        F.count(F.when(is_multi, 1)).alias("n_multi"),
        F.count(F.when(is_first, 1)).alias("n_first"),
        F.count(F.when(is_first & is_veg, 1)).alias("n_first_veg"),
        F.min(z).alias("ground"), F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.stddev_pop(v).alias("v_std"),
    )
    share = c("n_veg") / F.nullif((c("n_veg") + c("n_building")).cast("double"), F.lit(0.0))
    woody = F.coalesce((c("v_max") - c("ground") >= top_least) & (c("n_veg") >= 8) & (c("n_veg") / c("n") >= cover_least), F.lit(False))
    verdict = (
        F.when(c("n") < sparse, "sparse").when(share.isNull(), "mixed").when(share >= 0.7, F.when(woody, "vegetation").otherwise("low_vegetation"))
        .when(share <= 0.3, F.when(c("n_building") >= c("n_veg"), "building").otherwise("structure")).otherwise("mixed")
    )
    return g.select(
        key, "n", "n_veg", "n_building",
        (c("n_multi") / c("n")).alias("multi_share"),
        (c("n_first_veg") / F.nullif(c("n_first").cast("double"), F.lit(0.0))).alias("cover"),
        (c("v_max") - c("ground")).alias("top"), (c("v_min") - c("ground")).alias("base"), (c("v_mean") - c("ground")).alias("mean"), c("v_std").alias("spread"),
        ((c("v_mean") - c("v_min")) / F.nullif(c("v_max") - c("v_min"), F.lit(0.0))).alias("relief"),
        verdict.alias("verdict"),
    )


def foliage_profile(df: DataFrame, key: str, height: str, bin_m: float = 1.0, density: float = 0.25, least_m: float = 2.0, valley: float = 0.1, least_n: int = 8) -> DataFrame:
    """(key, n, profile, crown_base, layers): histogram of heights, the lowest sustained dense bin above least_m, and
    the runs of the profile smoothed over three bins. Groups below least_n returns get nulls."""
    n = df.where(c(height) >= 0).withColumn("bin", F.floor(c(height) / bin_m).cast("int")).groupBy(key, "bin").agg(F.count("*").alias("__k"))
    g = n.groupBy(key).agg(F.sum("__k").alias("n"), F.max("bin").alias("top"), F.map_from_entries(F.collect_list(F.struct("bin", "__k"))).alias("m"))
    p = F.transform(F.sequence(F.lit(0), c("top")), lambda b: F.coalesce(F.try_element_at(c("m"), b), F.lit(0).cast("long")))
    g = g.withColumn("profile", p).withColumn("peak", F.array_max("profile"))
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(0).cast("long"))
    first = int(least_m / bin_m)
    dense = F.filter(F.sequence(F.lit(first), F.greatest(c("top"), F.lit(first))), lambda b: (at(c("profile"), b) >= c("peak") * density) & (at(c("profile"), b + 1) >= c("peak") * density) & (b < c("top")))
    smooth = F.transform(F.sequence(F.lit(0), c("top")), lambda b: (at(c("profile"), b) + at(c("profile"), b + 1) + F.when(b > 0, at(c("profile"), F.greatest(b - 1, F.lit(0)))).otherwise(0)) / 3.0)
    g = g.withColumn("base", F.get(dense, F.lit(0)) * bin_m).withColumn("sm", smooth).withColumn("smax", F.array_max("sm"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("on"))
    up = lambda s, v: ~s["on"] & (v >= c("smax") * 0.25)
    down = lambda s, v: s["on"] & (v < c("smax") * valley)
    runs = F.aggregate("sm", zero, lambda s, v: F.struct((s["n"] + F.when(up(s, v), 1).otherwise(0)).alias("n"), (F.when(up(s, v), True).when(down(s, v), False).otherwise(s["on"])).alias("on")))
    ok = c("n") >= least_n
    return g.select(key, "n", F.when(ok, c("profile")).alias("profile"), F.when(ok, c("base")).alias("crown_base"), F.when(ok, F.greatest(runs["n"], F.lit(1))).alias("layers"))


def rugosity(df: DataFrame, key: str, px: Column, py: Column, z: str, least: int = 4) -> DataFrame:
    """Spread of the highest return per pixel, for at least `least` pixels."""
    p = df.groupBy(key, px.alias("px"), py.alias("py")).agg(F.max(z).alias("top"))
    g = p.groupBy(key).agg(F.count("*").alias("n_pixels"), F.stddev_pop("top").alias("rugosity"))
    return g.select(key, "n_pixels", F.when(c("n_pixels") >= least, c("rugosity")).alias("rugosity"))


# height cells
def cell_max(df: DataFrame, x: str, y: str, z: str, size: float) -> DataFrame:
    """(i, j, h): highest value per cell; rows without position or value are left out."""
    d = df.where(c(x).isNotNull() & c(y).isNotNull() & c(z).isNotNull())
    return d.groupBy(F.floor(c(x) / size).alias("i"), F.floor(c(y) / size).alias("j")).agg(F.max(z).alias("h"))


def _spread(cells: DataFrame, reach: int, agg) -> DataFrame:
    """agg of the values in the square of cells around each cell."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    p = cells.withColumn("o", F.explode(offsets)).select((c("i") + c("o.a")).alias("i"), (c("j") + c("o.b")).alias("j"), "h")
    return p.groupBy("i", "j").agg(agg("h").alias("h"))


def closing(cells: DataFrame, reach: int = 1) -> DataFrame:
    """Greyscale closing on the cells that are there: the smallest of the surrounding largest values."""
    wide = _spread(cells, reach, F.max)
    back = _spread(wide, reach, F.min)
    return cells.select("i", "j").join(back, ["i", "j"])


def local_peaks(cells: DataFrame, reach: int = 1, least: float = 3.0) -> DataFrame:
    """Cells that are the highest of their surroundings, ties to the smallest (i, j)."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    p = cells.withColumn("o", F.explode(offsets)).select((c("i") + c("o.a")).alias("ti"), (c("j") + c("o.b")).alias("tj"), F.struct((-c("h")).alias("n"), "i", "j").alias("k"))
    top = p.groupBy("ti", "tj").agg(F.min("k").alias("k")).where((c("k.i") == c("ti")) & (c("k.j") == c("tj")))
    return top.select(c("ti").alias("i"), c("tj").alias("j"), (-c("k.n")).alias("h")).where(c("h") >= least)


def seed_allocation(cells: DataFrame, seeds: DataFrame, size: float, reach: Column, most: float) -> DataFrame:
    """(i, j, seed): nearest seed of each cell within the seed's reach (from its height h), ties to the smaller seed.

    cells (i, j, h), seeds (seed, x, y, h)."""
    p = cells.select(F.concat_ws("_", "i", "j").alias("cid"), ((c("i") + 0.5) * size).alias("x"), ((c("j") + 0.5) * size).alias("y"), "i", "j")
    q = near_join(p, seeds.withColumn("reach", reach), ("cid", "x", "y"), ("seed", "x", "y"), most, ("i", "j"), ("reach",)).where(c("d") <= c("b_reach"))
    return q.groupBy(c("a_i").alias("i"), c("a_j").alias("j")).agg(F.min(F.struct("d", "b_id"))["b_id"].alias("seed"))


def height_crowns(cells: DataFrame, seeds: DataFrame, size: float, factor: float = 0.6, exclusion: float = 0.3, most: float = 14.0) -> DataFrame:
    """(i, j, h, seed): each cell to its nearest seed, kept if it lies within `factor` times the seed's height (at most
    `most`) and reaches `exclusion` of it; ties to the smaller seed. cells (i, j, h), seeds (seed, x, y, h)."""
    p = cells.select(F.concat_ws("_", "i", "j").alias("cid"), ((c("i") + 0.5) * size).alias("x"), ((c("j") + 0.5) * size).alias("y"), "i", "j", "h")
    q = near_join(p, seeds, ("cid", "x", "y"), ("seed", "x", "y"), most, ("i", "j", "h"), ("h",))
    g = q.groupBy(c("a_i").alias("i"), c("a_j").alias("j"), c("a_h").alias("h")).agg(F.min(F.struct("d", "b_id", "b_h")).alias("m"))
    return g.where((c("m.d") <= c("m.b_h") * factor) & (c("h") >= c("m.b_h") * exclusion)).select("i", "j", "h", c("m.b_id").alias("seed"))


def trim_heights(crowns: DataFrame, key: str, h: str = "h", share: float = 0.5, drop: float = 5.0, quantile: float = 0.25, bins: int = 32) -> DataFrame:
    """(key, top, by_share, by_drop, by_quantile, by_otsu): the height under which each crown's cells are cut off, for
    each way of trimming. by_otsu is the middle of the bin after which the crown's own heights part best; crowns of
    fewer than eight cells or of one height take by_share."""
    d = crowns.where(c(h).isNotNull()).select(c(key).alias("k"), c(h).alias("h"))
    g = d.groupBy("k").agg(F.count("*").alias("n"), F.max("h").alias("top"), F.min("h").alias("low"), F.percentile("h", F.lit(quantile)).alias("by_quantile"))
    wide = (c("top") - c("low")) / bins
    b = d.join(g, "k").where((c("n") >= 8) & (c("top") - c("low") >= 1e-6))
    b = b.groupBy("k", "n", "low", "top", F.least(F.floor((c("h") - c("low")) / wide), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("w"))
    mid = c("low") + (c("b") + 0.5) * wide
    run, whole = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("k")
    b = b.select("k", "n", mid.alias("mid"), F.sum("w").over(run).alias("w0"), F.sum(c("w") * mid).over(run).alias("m0"), F.sum(c("w") * mid).over(whole).alias("m"))
    w1 = c("n") - c("w0")
    gap = c("m0") / c("w0") - (c("m") - c("m0")) / F.greatest(w1, F.lit(1))
    o = b.groupBy("k").agg(F.max(F.struct((c("w0") * w1 * gap * gap).alias("v"), (-c("mid")).alias("m"))).alias("best"))
    cut_ = c("top") * share
    return g.join(o, "k", "left").select(c("k").alias(key), "top", cut_.alias("by_share"), (c("top") - drop).alias("by_drop"), "by_quantile", F.coalesce(-c("best.m"), cut_).alias("by_otsu"))


def missed_trees(cells: DataFrame, size: float, known: DataFrame, cols: tuple[str, str, str], reach: float, least: float = 3.0, tall: float = 8.0) -> DataFrame:
    """(i, j, h, tier): peaks of the heights without a known tree within `reach`; tier high where the peak has `tall`."""
    p = local_peaks(cells, 1, least).select(F.concat_ws("_", "i", "j").alias("pid"), "i", "j", "h", ((c("i") + 0.5) * size).alias("x"), ((c("j") + 0.5) * size).alias("y"))
    return without_near(p, ("pid", "x", "y"), known, cols, reach).select("i", "j", "h", F.when(c("h") >= tall, "high").otherwise("low").alias("tier"))


def trusted_links(links: DataFrame, crown: str, genus: str, allowed: Column | None = None) -> DataFrame:
    """Links of crowns on which one genus at most is recorded, with n_on_crown; links not allowed count nowhere."""
    l = links.where(c(crown).isNotNull() & (F.coalesce(allowed, F.lit(True)) if allowed is not None else F.lit(True)))
    g = l.groupBy(crown).agg(F.min(genus).alias("__lo"), F.max(genus).alias("__hi"), F.count("*").alias("n_on_crown"))
    return l.join(g.where(c("__lo").isNull() | (c("__lo") == c("__hi"))).select(crown, "n_on_crown"), crown)


def patches(cells: DataFrame, eight: bool = True, least: int = 1) -> DataFrame:
    """(i, j, patch): patches of neighbouring cells of at least `least` cells; the patch is its smallest cell."""
    key = lambda i, j: F.concat_ws("_", i, j)
    near = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if eight else [])
    own = cells.select("i", "j").distinct()
    e = own.select("i", "j", F.explode(F.array(*[F.struct((c("i") + a).alias("i"), (c("j") + b).alias("j")) for a, b in near])).alias("n"))
    e = e.join(own.select(F.struct("i", "j").alias("n")), "n").select(key(c("i"), c("j")).alias("a"), key(c("n.i"), c("n.j")).alias("b"))
    at = lambda k: F.split("item", "_")[k].cast("long")
    comp = connected_components(e).select(at(0).alias("i"), at(1).alias("j"), "root")
    head = comp.groupBy("root").agg(F.min(F.struct("i", "j")).alias("patch"))
    comp = comp.join(head, "root").select("i", "j", "patch")
    lone = own.join(comp, ["i", "j"], "left_anti").select("i", "j", F.struct("i", "j").alias("patch"))
    every = comp.unionByName(lone)
    big = every.groupBy("patch").agg(F.count("*").alias("n")).where(c("n") >= least).select("patch")
    return every.join(big, "patch").select("i", "j", "patch")


def shape(df: DataFrame, key: Sequence[str], x: str, y: str, sample: bool = False) -> DataFrame:
    """Length, width and elongation of a cloud of cells from its second moments, and the fill of its box."""
    vx, vy, vxy = (F.var_samp(x), F.var_samp(y), F.covar_samp(x, y)) if sample else (F.var_pop(x), F.var_pop(y), F.covar_pop(x, y))
    g = df.groupBy(*key).agg(F.count("*").alias("n"), vx.alias("a"), vy.alias("b"), vxy.alias("k"), F.max(x).alias("x1"), F.min(x).alias("x0"), F.max(y).alias("y1"), F.min(y).alias("y0"))
    root = F.sqrt(F.pow(c("a") - c("b"), F.lit(2.0)) / 4 + c("k") * c("k"))
    mid = (c("a") + c("b")) / 2
    big, small = mid + root, F.greatest(mid - root, F.lit(0.0))
    box = (c("x1") - c("x0") + 1) * (c("y1") - c("y0") + 1)
    return g.select(*key, "n", (F.sqrt(big) * 4).alias("length"), (F.sqrt(small) * 4).alias("width"), F.sqrt(big / F.greatest(small, F.lit(1e-6))).alias("elongation"), (c("n") / box).alias("fill"))


def zonal(df: DataFrame, key: str, v: str, cell_area: float) -> DataFrame:
    """Percentiles, spread, volume and vertical ratio of the values of a zone."""
    q = F.percentile(v, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
    g = df.where(c(v).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), q.alias("q"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (F.sum(v) * cell_area).alias("volume"))
    return g.select(key, "n", *[c("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75, 95))], "max", "mean", "std", "volume", (c("mean") / F.nullif(c("max"), F.lit(0.0))).alias("vertical_ratio"))


def zonal_change(df: DataFrame, key: str, old: str, new: str, years: float, canopy: float = 3.0, least: int = 3) -> DataFrame:
    """Change of the highest value and of canopy share between two surveys of the same cells, per zone."""
    o, n = F.when(c(old) >= canopy, 1.0).otherwise(0.0), F.when(c(new) >= canopy, 1.0).otherwise(0.0)
    g = df.where(c(old).isNotNull() & c(new).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.max(old).alias("h0"), F.max(new).alias("h1"), F.avg(o).alias("c0"), F.avg(n).alias("c1"), F.sum(o).alias("n0"))
    rate = (c("h1") - c("h0")) / years
    state = F.when(c("n0") < least, "too_little_canopy").when((c("c1") - c("c0") <= -0.5), "lost").when(rate > 0.1, "growing").when(rate < -0.1, "declining").otherwise("stable")
    return g.select(key, "n", (c("h1") - c("h0")).alias("change"), rate.alias("rate"), (c("c1") - c("c0")).alias("cover_change"), state.alias("state"))


def sample_max(points: DataFrame, p: tuple[str, str, str], cells: DataFrame, size: float, radius: float) -> DataFrame:
    """(p_id, h): highest cell centre within a radius of each point; null where there is none."""
    cc = cells.select(F.concat_ws("_", "i", "j").alias("cid"), ((c("i") + 0.5) * size).alias("x"), ((c("j") + 0.5) * size).alias("y"), "h")
    j = near_join(points, cc, p, ("cid", "x", "y"), radius, (), ("h",))
    return points.select(c(p[0]).alias("p_id")).join(j.groupBy(c("a_id").alias("p_id")).agg(F.max("b_h").alias("h")), "p_id", "left")


def disc_evidence(points: DataFrame, p: tuple[str, str, str], cells: DataFrame, size: float, radii: Sequence[float], tall: float = 3.0) -> DataFrame:
    """Per point and radius: cells, tall cells, share and highest value, all radii in one pass."""
    cc = cells.select(F.concat_ws("_", "i", "j").alias("cid"), ((c("i") + 0.5) * size).alias("x"), ((c("j") + 0.5) * size).alias("y"), "h")
    j = near_join(points, cc, p, ("cid", "x", "y"), max(radii), (), ("h",)).withColumnRenamed("b_h", "h")
    aggs = []
    for r in radii:
        name, near = str(r).replace(".", "_"), c("d") <= r
        aggs += [F.count(F.when(near, 1)).alias(f"n_{name}"), F.count(F.when(near & (c("h") >= tall), 1)).alias(f"tall_{name}"), F.max(F.when(near, c("h"))).alias(f"max_{name}")]
    return j.groupBy(c("a_id").alias("p_id")).agg(*aggs)


def canopy_cover(cells: DataFrame, zone: str, h: str, green: str, tall: float = 3.0, index: float = 0.05, least: float = 0.8) -> DataFrame:
    """Share of covered cells with canopy per zone, the share of cells covered, and whether it is a lower bound."""
    ok = c(h).isNotNull() & c(green).isNotNull()
    g = cells.groupBy(zone).agg(F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_ok"), F.count(F.when(ok & (c(h) >= tall) & (c(green) >= index), 1)).alias("n_canopy"))
    return g.select(zone, "n", (c("n_canopy") / F.nullif(c("n_ok").cast("double"), F.lit(0.0))).alias("cover"), (c("n_ok") / c("n")).alias("coverage"), (c("n_ok") / c("n") < least).alias("lower_bound"))


def low_canopy_score(h: Column, green: Column, lo: float = 1.0, hi: float = 5.0, g_lo: float = 0.0, g_hi: float = 0.2) -> Column:
    """0..1: 0.6 of the height scale and 0.4 of the greenness scale."""
    unit = lambda v, a, b: F.least(F.greatest((v - a) / (b - a), F.lit(0.0)), F.lit(1.0))
    return unit(h, lo, hi) * 0.6 + unit(green, g_lo, g_hi) * 0.4


def with_halo(df: DataFrame, x: str, y: str, tile: float, halo: float) -> DataFrame:
    """Rows in every tile whose padded box holds them; owner tells the tile that keeps the row (half-open)."""
    lo = lambda v: F.floor((c(v) - halo) / tile)
    hi = lambda v: F.floor((c(v) + halo) / tile)
    out = df.withColumn("tx", F.explode(F.sequence(lo(x), hi(x)))).withColumn("ty", F.explode(F.sequence(lo(y), hi(y))))
    return out.withColumn("owner", (c("tx") == F.floor(c(x) / tile)) & (c("ty") == F.floor(c(y) / tile)))


def flood(h: dict[tuple[int, int], float], peaks: list[tuple[int, int]], share: float, least: float) -> dict[tuple[int, int], int]:
    """Marker watershed on cells: from the peaks downwards, each cell to the peak that reaches it first, as long as
    it keeps `share` of the peak's height and `least`."""
    label = {p: k for k, p in enumerate(peaks)}
    heap = [(-h[p], p) for p in peaks]
    heapq.heapify(heap)
    while heap:
        _, (i, j) = heapq.heappop(heap)
        k = label[(i, j)]
        for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            q = (i + a, j + b)
            v = h.get(q)
            if v is not None and q not in label and v >= least and v >= share * h[peaks[k]]:
                label[q] = k
                heapq.heappush(heap, (-v, q))
    return label


def spacing_grow(h: dict[tuple[int, int], float], spacing, least: float) -> dict[tuple[int, int], int]:
    """Cells from the tallest down: to the tree of the nearest cell already given out within spacing(height) cells, else
    a tree of its own if it has `least`. Equal heights and distances go by (i, j)."""
    label: dict[tuple[int, int], int] = {}
    n = 0
    for (i, j), v in sorted(h.items(), key=lambda x: (-x[1], x[0])):
        s = spacing(v)
        k = int(math.ceil(s))
        near = [(a * a + b * b, i + a, j + b) for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= s * s and (i + a, j + b) in label]
        if near:
            label[(i, j)] = label[min(near)[1:]]
        elif v >= least:
            label[(i, j)] = n
            n += 1
    return label


def mean_grow(h: dict[tuple[int, int], float], peaks: list[tuple[int, int]], share: float, crown_share: float, most: float) -> dict[tuple[int, int], int]:
    """Crowns grow from their peaks ring by ring: a neighbouring cell joins if it has `share` of the peak's height and
    crown_share of the crown's mean so far, is no higher than 1.05 of the peak, and lies within `most` cells of it."""
    label = {p: k for k, p in enumerate(peaks)}
    total, count, rim = [h[p] for p in peaks], [1] * len(peaks), list(peaks)
    while rim:
        mean, new = [t / n for t, n in zip(total, count)], []
        for i, j in rim:
            k = label[(i, j)]
            p = peaks[k]
            for q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                v = h.get(q)
                if v is not None and q not in label and share * h[p] < v <= 1.05 * h[p] and v > crown_share * mean[k] and math.dist(p, q) < most:
                    label[q] = k
                    total[k] += v
                    count[k] += 1
                    new.append(q)
        rim = sorted(new)
    return label


def _segment(tile: int, reach: int, share: float, least: float, way: str, most: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = key
        h = {(int(i), int(j)): float(v) for i, j, v in zip(pdf["i"], pdf["j"], pdf["h"])}
        if way == "seeded":
            peaks = sorted((p for p, on in zip(zip(pdf["i"].astype(int), pdf["j"].astype(int)), pdf["seed"]) if on and h[p] >= least), key=lambda p: (-h[p], p))
        elif way != "spacing":
            peaks = [
                p for p, v in sorted(h.items(), key=lambda x: (-x[1], x[0]))
                if v >= least and all((-h.get((p[0] + a, p[1] + b), -1e9), p[0] + a, p[1] + b) >= (-v, *p) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1))
            ]
        if way == "spacing":
            label = spacing_grow(h, lambda v: min(max(1.0 + v * share, 1.0), most), least)
            first: dict[int, tuple[int, int]] = {}
            for q, k in label.items():  # the tallest cell comes first
                first.setdefault(k, q)
            peaks = [first[k] for k in range(len(first))]
        elif way == "mean":
            label = mean_grow(h, peaks, share, min(1.0, share + 0.1), most)
        else:
            label = {q: k for q, k in flood(h, peaks, share, least).items() if way != "seeded" or math.dist(q, peaks[k]) <= most}
        area: dict[int, int] = {}
        for k in label.values():
            area[k] = area.get(k, 0) + 1
        rows = [(p[0], p[1], h[p], area[k]) for k, p in enumerate(peaks) if p[0] // tile == tx and p[1] // tile == ty]
        return pd.DataFrame(rows, columns=["i", "j", "h", "n_cells"])

    return run


def segment_crowns(cells: DataFrame, tile: int = 64, halo: int = 12, reach: int = 1, share: float = 0.5, least: float = 3.0, way: str = "watershed", most: float = 12.0) -> DataFrame:
    """(i, j, h, n_cells) of each crown, per tile of cells with a halo; a crown belongs to the tile of its peak. A task
    sees at most (tile + 2 halo)^2 cells.

    way: watershed (marker watershed from local peaks), mean (region growing against the crown's mean), spacing (cells
    from the tallest down, by a spacing that grows with height by `share`), seeded (watershed from the cells whose
    column seed is true, within `most` cells). `most` bounds the reach of a crown in cells, at most the halo.
    """
    if way not in ("watershed", "mean", "spacing", "seeded") or most > halo:
        raise ValueError("unknown way, or a reach beyond the halo")
    t = with_halo(cells, "i", "j", tile, halo)
    return t.groupBy("tx", "ty").applyInPandas(_segment(tile, reach, share, least, way, most), "i long, j long, h double, n_cells long")


def record_crowns(cells: DataFrame, crowns: DataFrame, records: DataFrame, cols: tuple[str, str, str], size: float, reach: float, share: float = 0.5, least: float = 3.0, most: float = 8.0) -> DataFrame:
    """(id, i, j, h, n_cells): crowns grown for records without one, on cells that no crown (i, j) covers.

    A record takes the highest free cell within `reach`, ties to the smaller (i, j), and its crown is flooded from
    there over free cells that keep `share` of it, within `most` cells. Records that take one cell share its crown.
    """
    free = cells.join(crowns.select("i", "j").distinct(), ["i", "j"], "left_anti")
    p = free.select(F.concat_ws("_", "i", "j").alias("cid"), ((c("i") + 0.5) * size).alias("x"), ((c("j") + 0.5) * size).alias("y"), F.struct((-c("h")).alias("n"), "i", "j").alias("k"))
    top = near_join(records, p, cols, ("cid", "x", "y"), reach, (), ("k",)).groupBy(c("a_id").alias("id")).agg(F.min("b_k").alias("k")).select("id", "k.i", "k.j")
    seeded = free.join(top.select("i", "j").distinct().withColumn("seed", F.lit(True)), ["i", "j"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    return top.join(segment_crowns(seeded, share=share, least=least, way="seeded", most=most), ["i", "j"]).select("id", "i", "j", "h", "n_cells")


# repeated surveys
def stitch(a: DataFrame, b: DataFrame, years: float, radius: float = 4.0, up: float = 1.5, down: float = 2.5, weight: float = 2.0) -> DataFrame:
    """(l, r, cost, exact) one-to-one between apexes (id, x, y, h) of two surveys: near, and growth within bounds."""
    p = near_join(a, b, ("id", "x", "y"), ("id", "x", "y"), radius, ("h",), ("h",))
    g = (c("b_h") - c("a_h")) / years
    bad = F.greatest(g - up, F.lit(0.0)) + F.greatest(-g - down, F.lit(0.0))
    return optimal_pairs(p.withColumn("bad", bad).where("bad <= 1").withColumn("cost", c("d") + c("bad") * weight), "a_id", "b_id", "cost")


def fate(p24: Column, h13: Column, h16: Column, h24: Column, green: Column, tall: float = 5.0, ground: float = 2.0, leaf: float = 0.05) -> Column:
    """Outcome of a trajectory; heights null or NaN mean the survey did not cover the place, and tell nothing."""
    val = lambda v: F.nanvl(v, F.lit(None).cast("double"))
    true = lambda x: F.coalesce(x, F.lit(False))
    h13, h16, h24, green = val(h13), val(h16), val(h24), val(green)
    can = {k: true(v >= tall) for k, v in (("13", h13), ("16", h16), ("24", h24))}
    low = {k: true(v < ground) for k, v in (("13", h13), ("16", h16), ("24", h24))}
    lush, prior, p = true(green >= leaf), can["13"] | can["16"], true(p24)
    return (
        F.when(p & low["13"] & ~can["16"], "established_since_2013")
        .when(p & low["16"], "established_since_2016")
        .when(p & prior, "persistent")
        .when(p & h13.isNull() & h16.isNull(), "outside_historic_coverage")
        .when(~p & low["24"] & prior, "removed_to_open")
        .when(~p & can["24"] & ~lush & prior, "candidate_conversion")
        .when(~p & can["24"] & lush & prior, "persistent")
        .otherwise("indeterminate")
    )


def removal_confidence(p13: Column, p16: Column, h16: Column, implausible: Column) -> Column:
    both = p13.cast("int") + p16.cast("int")
    score = both + F.coalesce(F.when(h16 >= 12, 2).when(h16 >= 8, 1), F.lit(0)) + F.when(implausible, 0).otherwise(1)
    return F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")


def height_forecast(h: Column, cohort: Column, own: Column, years: float, weight: float = 0.5) -> Column:
    """Height after some years from the cohort's and the own yearly rate, not below 0."""
    return F.greatest(h + F.when(own.isNull(), cohort).otherwise(cohort * (1 - weight) + own * weight) * years, F.lit(0.0))


# linking
def runs_of(df: DataFrame, group: str, seq: str, x: str, y: str, id_col: str, gap: int = 2, link: float = 25.0, most: int = 12) -> DataFrame:
    """(id, run): chains of records with near numbers and places, at least 3 long, cut into runs of even size."""
    w = Window.partitionBy(group).orderBy(seq, id_col)
    far = F.sqrt(F.pow(c(x) - F.lag(x).over(w), F.lit(2.0)) + F.pow(c(y) - F.lag(y).over(w), F.lit(2.0)))
    brk = ~((c(seq) - F.lag(seq).over(w) <= gap) & (far <= link))
    d = df.withColumn("__b", F.coalesce(brk, F.lit(True)).cast("int")).withColumn("chain", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    k = Window.partitionBy(group, "chain")
    d = d.withColumn("pos", F.row_number().over(k.orderBy(seq, id_col)) - 1).withColumn("n", F.count("*").over(k)).where("n >= 3")
    size = F.ceil(c("n") / F.ceil(c("n") / most))
    return d.select(c(id_col).alias("id"), F.concat_ws("_", group, c("chain").cast("string"), F.floor(c("pos") / size).cast("string")).alias("run"), c(x).alias("x"), c(y).alias("y"))


def _align(most: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy(float)
        tops = [np.array([(t["x"], t["y"]) for t in ts], dtype=float).reshape(-1, 2) for ts in pdf["tops"]]
        best = (0.0, 0.0, math.inf)
        shifts = [np.zeros(2), *[t - p[i] for i, ts in enumerate(tops) for t in ts if np.hypot(*(t - p[i])) <= most]]

        def cost(v):
            return sum(min(np.hypot(*(ts - p[i] - v).T).min() if len(ts) else 5.0, 5.0) for i, ts in enumerate(tops)) / len(p)

        for v in shifts:
            k = cost(v)
            if k < best[2] - 1e-12:
                best = (float(v[0]), float(v[1]), float(k))
        # one step to the mean of the tops that now are nearest
        v = np.array(best[:2])
        near = [ts[np.argmin(np.hypot(*(ts - p[i] - v).T))] - p[i] for i, ts in enumerate(tops) if len(ts)]
        if near and cost(np.mean(near, axis=0)) < best[2]:
            v = np.mean(near, axis=0)
            best = (float(v[0]), float(v[1]), float(cost(v)))
        return pd.DataFrame([(pdf["run"].iloc[0], best[0], best[1], float(cost(np.zeros(2))), best[2], len(p))], columns=["run", "dx", "dy", "before", "after", "n"])

    return run


def align_runs(members: DataFrame, tops: DataFrame, t: tuple[str, str, str], reach: float = 12.0) -> DataFrame:
    """(run, dx, dy, before, after, n): the common shift of a run that brings its records nearest to crown tops."""
    j = near_join(members, tops, ("id", "x", "y"), t, reach)
    near = j.groupBy(c("a_id").alias("id")).agg(F.collect_list(F.struct(c("bx").alias("x"), c("by").alias("y"))).alias("tops"))
    m = members.join(near, "id", "left").withColumn("tops", F.coalesce("tops", F.array().cast("array<struct<x:double,y:double>>")))
    return m.groupBy("run").applyInPandas(_align(reach), "run string, dx double, dy double, before double, after double, n int")


def pav_decreasing(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted non-increasing fit by pooling neighbours."""
    blocks: list[list[float]] = []
    for v, k in zip(y, w):
        blocks.append([float(v), float(k), 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            total = a[1] + b[1]
            blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]]
    return np.array([b[0] for b in blocks for _ in range(int(b[2]))])


def offset_evidence(true_counts: np.ndarray, decoy_rate: np.ndarray, records: int, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Monotone log-likelihood ratio per distance bin and the share of records with a true partner.

    true_counts: crowns near records per bin; decoy_rate: crowns per decoy place per bin. A two-part mixture: each
    bin's count is chance plus the partner's offset law, fitted by EM on the counts.
    """
    f = np.full(len(true_counts), 1 / len(true_counts))
    pi = 0.5
    chance = np.maximum(decoy_rate, 1e-6) * records
    for _ in range(rounds):
        w = pi * records * f
        resp = true_counts * w / np.maximum(w + chance, 1e-12)
        pi = min(0.999, max(0.001, resp.sum() / max(records, 1)))
        f = (resp + 1e-6) / (resp.sum() + 1e-6 * len(f))
    return pav_decreasing(np.log(np.maximum(pi * f, 1e-9) / np.maximum(decoy_rate, 1e-6)), true_counts + 1), pi


def conditional_logit(options: DataFrame, qid: str, chosen: str, features: Sequence[str], rounds: int = 8, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a choice model: the chosen option of each query against its others, by Newton steps.

    Each step is one pass of aggregates: per query the weighted sums of its options, over all queries gradient and
    curvature; only these k + k * k numbers reach the driver. Utilities are shifted by the query's largest. Queries
    without a chosen option tell nothing.
    """
    k = len(features)
    x = [c(f"f{i}") for i in range(k)]
    o = options.select(c(qid).alias("q"), c(chosen).cast("double").alias("y"), *[c(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    o = cut(o.repartition("q"))
    b = np.zeros(k)
    for _ in range(rounds):
        u = reduce(Column.__add__, [v * float(w) for v, w in zip(x, b)])
        e = F.exp(c("u") - c("top"))
        s = o.withColumn("u", u).withColumn("top", F.max("u").over(Window.partitionBy("q"))) if np.any(b) else o.withColumn("u", F.lit(0.0)).withColumn("top", F.lit(0.0))
        g = s.groupBy("q").agg(
            F.sum(e).alias("z"), F.sum("y").alias("n"),
            *[F.sum(e * v).alias(f"e{i}") for i, v in enumerate(x)], *[F.sum(c("y") * v).alias(f"y{i}") for i, v in enumerate(x)],
            *[F.sum(e * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)],
        ).where("n > 0")
        m = [c(f"e{i}") / c("z") for i in range(k)]
        total = g.agg(*[F.sum(c(f"y{i}") / c("n") - m[i]).alias(f"g{i}") for i in range(k)], *[F.sum(c(f"h{i}_{j}") / c("z") - m[i] * m[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        grad = np.array([total[f"g{i}"] or 0.0 for i in range(k)])
        hess = np.array([[total[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        step = np.linalg.solve(hess + ridge * np.eye(k), grad - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fold_of(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("binary")) % folds


def displaced(x: Column, y: Column, key: Column, r_lo: float, r_hi: float, seed: int = 1) -> Column:
    """struct(x, y): a place at a seeded angle and distance; rows with the same key share the shift."""
    u = lambda s: (F.pmod(F.xxhash64(key, F.lit(seed + s)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    v = F.struct((u(0) * (2 * math.pi)).alias("a"), (u(1) * (r_hi - r_lo) + r_lo).alias("r"))
    return let(v, lambda s: F.struct((x + F.cos(s["a"]) * s["r"]).alias("x"), (y + F.sin(s["a"]) * s["r"]).alias("y")))


def binary_scores(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(n, precision, recall, f1) of a yes-no prediction."""
    g = df.agg(F.count("*").alias("n"), F.count(F.when(truth & guess, 1)).alias("tp"), F.count(F.when(guess, 1)).alias("p"), F.count(F.when(truth, 1)).alias("t"))
    d = lambda a, b: c(a) / F.nullif(c(b).cast("double"), F.lit(0.0))
    return g.select("n", d("tp", "p").alias("precision"), d("tp", "t").alias("recall"), (c("tp") * 2.0 / F.nullif((c("p") + c("t")).cast("double"), F.lit(0.0))).alias("f1"))


def smooth(cells: DataFrame, reach: int = 1) -> DataFrame:
    """Mean of the cells around each cell, of those that are there."""
    return cells.select("i", "j").join(_spread(cells, reach, F.avg), ["i", "j"])


def despike(cells: DataFrame, reach: int = 1, most: float = 5.0) -> DataFrame:
    """Cells higher than the median of their surroundings by more than `most` take that median."""
    m = _spread(cells, reach, F.median).withColumnRenamed("h", "__m")
    return cells.join(m, ["i", "j"]).select("i", "j", F.when(c("h") - c("__m") > most, c("__m")).otherwise(c("h")).alias("h"))


def otsu(df: DataFrame, keys: Sequence[str], v: str, bin_size: float = 1.0) -> DataFrame:
    """(keys, n, threshold): upper edge of the histogram bin that splits the values with most between-class variance."""
    h = df.where(c(v).isNotNull()).groupBy(*keys, F.floor(c(v) / bin_size).alias("__bin")).agg(F.count("*").alias("__k"))
    w = Window.partitionBy(*keys)
    up = w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    x = c("__bin") * bin_size
    t = h.select(*keys, "__bin", F.sum("__k").over(up).alias("__n0"), F.sum(x * c("__k")).over(up).alias("__s0"), F.sum("__k").over(w).alias("__n"), F.sum(x * c("__k")).over(w).alias("__s"))
    n1 = F.nullif((c("__n") - c("__n0")).cast("double"), F.lit(0.0))
    diff = c("__s0") / c("__n0") - (c("__s") - c("__s0")) / n1
    between = F.coalesce(c("__n0") * n1 * diff * diff, F.lit(-1.0))
    best = t.groupBy(*keys).agg(F.max("__n").alias("n"), F.max(F.struct(between.alias("b"), (-c("__bin")).alias("m"))).alias("__b"))
    return best.select(*keys, "n", ((-c("__b.m") + 1) * bin_size).alias("threshold"))


def saddle_share(pairs: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], cells: DataFrame, size: float, steps: int = 10, ends: bool = True) -> DataFrame:
    """pairs with `saddle`: lowest cell on the line between two tops over the lower of their heights.

    a and b name the (x, y, height) columns of the tops; cells that are missing count as 0. Without `ends` only the
    steps between the tops count, not the tops themselves. Rows of pairs must be distinct.
    """
    first, last = (0, steps) if ends else (1, steps - 1)
    p = pairs.withColumn("__k", F.explode(F.sequence(F.lit(first), F.lit(last))))
    at = lambda k: F.floor((c(a[k]) + (c(b[k]) - c(a[k])) * c("__k") / steps) / size)
    j = p.withColumn("i", at(0)).withColumn("j", at(1)).join(cells.select("i", "j", c("h").alias("__h")), ["i", "j"], "left")
    g = j.groupBy(*pairs.columns).agg(F.min(F.coalesce("__h", F.lit(0.0))).alias("__low"))
    return g.select(*pairs.columns, (c("__low") / F.nullif(F.least(c(a[2]), c(b[2])), F.lit(0.0))).alias("saddle"))


def segmentation_scores(overlaps: DataFrame, truth: str, found: str, area: str, truth_share: str, found_share: str, least: float = 0.5) -> DataFrame:
    """One row: number of true crowns, recall, split, merge, median IoU and a harmonic objective.

    A true crown is recalled if a found one covers `least` of it; split if two found ones each cover a fifth of it;
    merged if its best found crown is best for others too. Crowns' areas follow from overlap and share.
    """
    o = overlaps.where(c(area).isNotNull() & (c(truth_share) > 0) & (c(found_share) > 0))
    iou = c(area) / (c(area) / c(truth_share) + c(area) / c(found_share) - c(area))
    g = o.groupBy(truth).agg(F.max(truth_share).alias("__c"), F.count(F.when(c(truth_share) >= 0.2, 1)).alias("__s"), F.max(iou).alias("__i"), F.max(F.struct(c(area), c(found)))[found].alias("__f"))
    m = g.groupBy("__f").agg(F.count("*").alias("__m"))
    t = g.join(m, "__f")
    r = t.agg(F.count("*").alias("n"), F.avg((c("__c") >= least).cast("double")).alias("recall"), F.avg((c("__s") >= 2).cast("double")).alias("split"), F.avg((c("__m") > 1).cast("double")).alias("merge"), F.median("__i").alias("iou"))
    good = F.lit(3.0) / (F.lit(1.0) / F.nullif(c("recall"), F.lit(0.0)) + F.lit(1.0) / F.nullif(1 - c("split"), F.lit(0.0)) + F.lit(1.0) / F.nullif(c("iou"), F.lit(0.0)))
    return r.withColumn("objective", good)


def merge_clusters(df: DataFrame, cols: tuple[str, str, str], cells: DataFrame, size: float, rank: Column, area: str, radius: float, share: float = 0.6, least: float = 3.0, interior: int = 4, auto_most: int = 5) -> DataFrame:
    """(id, cluster, size, merge_class, is_primary): items with unbroken canopy between them, taken as one crown.

    The heights at both items and at `interior` places between them are read from the cells (i, j, h); a pair is
    confirmed if the lower top has `least` and the lowest place between reaches `share` of it. Missing cells count
    as 0. Clusters up to auto_most merge by themselves, larger ones are for review. The primary comes first by rank,
    then area, then id. Only confirmed pairs link, so a row with gaps never chains.
    """
    s = df.select(c(cols[0]).alias("id"), c(cols[1]).alias("x"), c(cols[2]).alias("y"), rank.alias("rk"), c(area).alias("ar"))
    p = near_pairs(s, ("id", "x", "y"), radius, ("x", "y"))
    t = p.select("a_id", "b_id", F.explode(F.sequence(F.lit(0), F.lit(interior + 1))).alias("k"), *["a_x", "a_y", "b_x", "b_y"])
    at = lambda v: F.floor((c(f"a_{v}") + (c(f"b_{v}") - c(f"a_{v}")) * c("k") / (interior + 1)) / size)
    t = t.select("a_id", "b_id", "k", at("x").alias("i"), at("y").alias("j")).join(cells.select("i", "j", "h"), ["i", "j"], "left")
    h, end = F.coalesce("h", F.lit(0.0)), c("k").isin(0, interior + 1)
    t = t.groupBy("a_id", "b_id").agg(F.min(F.when(end, h)).alias("top"), F.min(F.when(~end, h)).alias("low"))
    k = components(t.where((c("top") >= least) & (c("low") >= c("top") * share))).join(s.select("id", "rk", "ar"), "id")
    g = k.groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct("rk", (-F.coalesce("ar", F.lit(0.0))).alias("na"), "id"))["id"].alias("first"))
    return k.join(g, "component").select("id", c("component").alias("cluster"), "size", F.when(c("size") <= auto_most, "auto").otherwise("review_large").alias("merge_class"), (c("id") == c("first")).alias("is_primary"))


def prior_adjusted(p: Column, trained: float, target: float) -> Column:
    """Probability re-weighted from the share of positives in training to that expected."""
    a, b = p * (target / trained), (1 - p) * ((1 - target) / (1 - trained))
    return a / F.nullif(a + b, F.lit(0.0))
