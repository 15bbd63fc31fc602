"""Points near other points or inside regions.

Regions are cut into triangles by ear clipping. The upper levels of a bounding-volume hierarchy, fitted on a
bounded sample of positions, spread triangles and points over leaves (every row is indexed); within a leaf a
hierarchy over the triangles' boxes gives candidates that are tested exactly. A point on a border shared by two
triangles of a region counts once. A disc is a circumscribed polygon followed by the exact distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.functions.triangles import TopTree, ear_clip, hits

EARTH_M = 6_371_008.8
SAMPLE_LEAST, SAMPLE_MOST, SAMPLE_PER_LEAF = 20_000, 1_000_000, 8
LEAF_ROWS = 16_000
LEAVES_MOST = 125_000
SIDES = 6


def usable(lon: Column, lat: Column) -> Column:
    """A position on the globe: neither null nor NaN, within range, not the null island."""
    lo, la = lon.cast("double"), lat.cast("double")
    ok = lo.isNotNull() & la.isNotNull() & ~F.isnan(lo) & ~F.isnan(la)
    return ok & lo.between(-180, 180) & la.between(-90, 90) & ~((lo == 0) & (la == 0))


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    dla, dlo = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dla), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlo), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_M)


def disc_triangles(df: DataFrame, id_cols: list[str], lon: str, lat: str, radius_m: float) -> DataFrame:
    """(*id_cols, lon, lat, part, tri): triangles of the polygon around each disc, tri as six numbers."""
    t = np.arange(SIDES) * 2 * math.pi / SIDES
    grown = radius_m * (1 + 1e-4) / math.cos(math.pi / SIDES)
    template = ear_clip(np.stack([np.cos(t), np.sin(t)], axis=1) * grown).reshape(-1, 6)
    per_deg = math.radians(1) * EARTH_M
    dx = F.lit(1.0) / (F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-6)) * per_deg)
    # discs over the date line are laid on both sides of it
    reach = dx * grown
    shifts = F.array_compact(F.array(F.lit(0.0), F.when(F.col(lon) + reach > 180, F.lit(-360.0)), F.when(F.col(lon) - reach < -180, F.lit(360.0))))
    at = df.withColumn("__shift", F.explode(shifts))
    tris = F.array(
        *[F.array(*[(F.col(lon) + F.col("__shift") + F.lit(float(v)) * dx) if i % 2 == 0 else (F.col(lat) + F.lit(float(v)) / per_deg) for i, v in enumerate(row)]) for row in template]
    )
    return at.select(*id_cols, lon, lat, F.lit(0).alias("part"), F.explode(tris).alias("tri"))


def region_triangles(df: DataFrame, id_col: str, rings: str) -> DataFrame:
    """(id_col, part, tri) of regions given as arrays of rings of (x, y) structs; the first ring is the outline,
    others are holes or further outlines (odd-even rule). Null regions and degenerate rings give no triangle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, part, tri = [], [], []
            for row in batch.to_pylist():
                for k, ring in enumerate(row[rings] or ()):
                    for t in ear_clip([(q["x"], q["y"]) for q in ring or ()]):
                        who.append(row[id_col]), part.append(k), tri.append(t.ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(who, batch.schema.field(0).type), pa.array(part, pa.int32()), pa.array(tri, pa.list_(pa.float64()))], names=[id_col, "part", "tri"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, rings).mapInArrow(cut, f"`{id_col}` {kind}, part int, tri array<double>")


def _sample(df: DataFrame, x: Column, y: Column, n: int, want: int) -> np.ndarray:
    """About `want` positions, twice as many at most."""
    part = min(1.0, want / max(n, 1))
    got = (df if part == 1.0 else df.sample(fraction=part, seed=7)).select(x.alias("x"), y.alias("y")).limit(2 * want).toPandas()
    return got.to_numpy(np.float64).reshape(-1, 2)


def points_in_triangles(points: DataFrame, x: str, y: str, p_cols: list[str], triangles: DataFrame, t_cols: list[str], leaf_rows: int = LEAF_ROWS, fit_on: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(*p_cols, *t_cols, part): point and triangle pairs where the point is inside or on the border.

    The tree is fitted on counts and a sample of fit_on, frames like points and triangles that may hold repeated rows
    and so are cheaper to read; by default of the two themselves.

    A crowded leaf is split into blocks of points times blocks of triangles, so no task sees more than about
    leaf_rows of either. Rows may repeat where a point lies on a shared border. Column names of both sides must differ.
    """
    like_p, like_t = fit_on or (points, triangles)
    n_p, n_t = like_p.count(), like_t.count()
    if n_p == 0 or n_t == 0:
        kinds = {f.name: f.dataType.simpleString() for f in [*points.schema, *triangles.schema]}
        return points.sparkSession.createDataFrame([], ", ".join(f"`{x}` {kinds[x]}" for x in [*p_cols, *t_cols, "part"]))
    t0 = F.col("tri")
    leaf_rows = max(leaf_rows, (n_p + n_t) // LEAVES_MOST)
    want = min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_PER_LEAF * (n_p + n_t) // leaf_rows))
    sp = _sample(like_p, F.col(x), F.col(y), n_p, want)
    st = _sample(like_t, t0[0], t0[1], n_t, want)
    # the side that was sampled more thinly sets how many samples a leaf may hold
    both = np.concatenate([sp, st])
    share = min(max(len(sp), 1) / n_p, max(len(st), 1) / n_t)
    tree = TopTree(both, max(1, int(leaf_rows * share)))
    blocks_p = np.ones(len(tree.weight), dtype=np.int64)
    blocks_t = blocks_p.copy()
    for s, blocks, n in ((sp, blocks_p, n_p), (st, blocks_t, n_t)):
        seen = np.bincount(tree.leaf_of(s), minlength=len(blocks)) if len(s) else np.zeros(len(blocks))
        blocks[:] = np.maximum(1, np.ceil(seen * (n / max(len(s), 1)) / (2 * leaf_rows)))

    @F.pandas_udf("array<long>")
    def of_points(px: pd.Series, py: pd.Series, h: pd.Series) -> pd.Series:
        leaf = tree.leaf_of(np.stack([px, py], axis=1).astype(np.float64))
        mine = h.to_numpy() % blocks_p[leaf]
        return pd.Series([[(int(a) * 4096 + int(b)) * 4096 + j for j in range(c)] for a, b, c in zip(leaf, mine, blocks_t[leaf])])

    @F.pandas_udf("array<long>")
    def of_triangles(tri: pd.Series, h: pd.Series) -> pd.Series:
        t = np.array(tri.tolist(), dtype=np.float64).reshape(-1, 3, 2)
        who, leaf = tree.leaves_of(np.concatenate([t.min(axis=1), t.max(axis=1)], axis=1))
        hv = h.to_numpy()
        got: list[list[int]] = [[] for _ in range(len(t))]
        for i, a in zip(who.tolist(), leaf.tolist()):
            b = int(hv[i] % blocks_t[a])
            got[i] += [(a * 4096 + j) * 4096 + b for j in range(int(blocks_p[a]))]
        return pd.Series(got)

    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30))
    left = points.select(*p_cols, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    left = left.withColumn("__leaf", F.explode(of_points("__x", "__y", salt("__x", "__y", *p_cols))))
    right = triangles.select(*t_cols, "part", "tri").withColumn("__leaf", F.explode(of_triangles("tri", salt("tri", *t_cols))))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p = a[["__x", "__y"]].to_numpy(np.float64)
        t = np.array(b["tri"].tolist(), dtype=np.float64).reshape(-1, 3, 2)
        i, j = hits(p, t)
        return pd.concat([a[p_cols].iloc[i].reset_index(drop=True), b[[*t_cols, "part"]].iloc[j].reset_index(drop=True)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*p_cols, *t_cols, "part"])
    return left.groupBy("__leaf").cogroup(right.groupBy("__leaf")).applyInPandas(match, schema)


def points_in_regions(points: DataFrame, point_id: str, x: str, y: str, regions: DataFrame, region_id: str, rings: str) -> DataFrame:
    """(point_id, region_id) of the regions that hold each point (border included, odd-even rule over rings)."""
    tris = region_triangles(regions, region_id, rings)
    ok = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    found = points_in_triangles(ok, x, y, [point_id], tris, [region_id]).distinct()
    return found.groupBy(point_id, region_id).agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select(point_id, region_id)


def near_points(centres: DataFrame, centre_id: Column, others: DataFrame, other_id: Column, radius_m: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(centre_id, other_id, distance_m): every other point at most radius_m from each centre, both usable.

    An id with several positions pairs by each of them and the smallest distance is told; rows with a null id or an
    unusable position are left out; exact copies count once. Empty sides give no rows.
    """

    def clean(df: DataFrame, who: Column, p: str) -> DataFrame:
        d = df.select(who.alias(f"{p}_id"), F.col(lon).cast("double").alias(f"{p}_lon"), F.col(lat).cast("double").alias(f"{p}_lat"))
        return d.where(F.col(f"{p}_id").isNotNull() & usable(F.col(f"{p}_lon"), F.col(f"{p}_lat")))

    c, o = clean(centres, centre_id, "centre"), clean(others, other_id, "other")
    discs = lambda df: disc_triangles(df, ["centre_id"], "centre_lon", "centre_lat", radius_m)
    # the tree is fitted before repeated rows are removed, so that only the search itself shuffles
    found = points_in_triangles(o.distinct(), "other_lon", "other_lat", ["other_id", "other_lon", "other_lat"], discs(c.distinct()), ["centre_id", "centre_lon", "centre_lat"], fit_on=(o, discs(c)))
    d = metres(F.col("centre_lon"), F.col("centre_lat"), F.col("other_lon"), F.col("other_lat"))
    near = found.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)
    return near.groupBy("centre_id", "other_id").agg(F.min("distance_m").alias("distance_m"))
