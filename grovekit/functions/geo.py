"""Projections and plane geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovekit.functions.text import let


def equirect(lon: Column, lat: Column, lat0: float, m_lat: float = 111132.0, m_lon: float = 111320.0) -> Column:
    """struct(x, y) in metres by scaling degrees at a fixed latitude."""
    return F.struct((lon * (m_lon * math.cos(math.radians(lat0)))).alias("x"), (lat * m_lat).alias("y"))


#: fixed values: GRS80 ellipsoid and the transverse Mercator parameters of the national grid
A, FLAT, K0, LON0, FE, FN = 6378137.0, 1 / 298.257222101, 0.9996, 173.0, 1600000.0, 10000000.0


def _meridian(phi: Column) -> Column:
    e2 = FLAT * (2 - FLAT)
    a0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    a2 = 3 / 8 * (e2 + e2**2 / 4 + 15 * e2**3 / 128)
    a4 = 15 / 256 * (e2**2 + 3 * e2**3 / 4)
    a6 = 35 * e2**3 / 3072
    return (phi * a0 - F.sin(phi * 2) * a2 + F.sin(phi * 4) * a4 - F.sin(phi * 6) * a6) * A


def to_grid(lon: Column, lat: Column) -> Column:
    """struct(x, y): transverse Mercator series to the sixth order."""
    e2 = FLAT * (2 - FLAT)
    ep = e2 / (1 - e2)

    def series(v: Column) -> Column:
        n, t, cc, a, tan = v["n"], v["t"], v["cc"], v["a"], v["tan"]
        x = a + (1 - t + cc) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep) * a * a * a * a * a / 120
        y = a * a / 2 + (5 - t + 9 * cc + 4 * cc * cc) * a * a * a * a / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep) * a * a * a * a * a * a / 720
        return F.struct((n * x * K0 + FE).alias("x"), ((v["m"] + n * tan * y) * K0 + FN).alias("y"))

    def trig(v: Column) -> Column:
        s, c = F.sin(v["phi"]), F.cos(v["phi"])
        n = F.lit(A) / F.sqrt(F.lit(1.0) - s * s * e2)
        parts = F.struct(n.alias("n"), (s * s / (c * c)).alias("t"), (c * c * ep).alias("cc"), (v["lam"] * c).alias("a"), (s / c).alias("tan"), _meridian(v["phi"]).alias("m"))
        return let(parts, series)

    return let(F.struct(F.radians(lat).alias("phi"), F.radians(lon - LON0).alias("lam")), trig)


def from_grid(x: Column, y: Column, steps: int = 6) -> Column:
    """struct(lon, lat): Newton steps on the forward series, from a spherical start."""
    lat0 = (y - FN) / (K0 * 111132.95)
    at = F.struct(((x - FE) / (F.cos(F.radians(lat0)) * (K0 * 111320.0)) + LON0).alias("lon"), lat0.alias("lat"))

    def nearer(p: Column) -> Column:
        return let(
            to_grid(p["lon"], p["lat"]),
            lambda g: F.struct((p["lon"] + (x - g["x"]) / (F.cos(F.radians(p["lat"])) * (K0 * 111320.0))).alias("lon"), (p["lat"] + (y - g["y"]) / (K0 * 111132.95)).alias("lat")),
        )

    for _ in range(steps):
        at = let(at, nearer)
    return at


def _edges(ring: Column) -> Column:
    """Array of struct(a, b) of neighbouring corners, the last joined to the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, 100000), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + f(e))


def ring_area(ring: Column) -> Column:
    """Signed area, positive counter-clockwise."""
    return _sum(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def ring_perimeter(ring: Column) -> Column:
    return _sum(_edges(ring), lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], F.lit(2.0)) + F.pow(e["b"]["y"] - e["a"]["y"], F.lit(2.0))))


def ring_centroid(ring: Column) -> Column:
    """struct(x, y) of the area centre; null for an area of 0."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    six = F.nullif(ring_area(ring) * 6, F.lit(0.0))
    return F.struct(
        (_sum(_edges(ring), lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)) / six).alias("x"),
        (_sum(_edges(ring), lambda e: (e["a"]["y"] + e["b"]["y"]) * cross(e)) / six).alias("y"),
    )


def farthest(ring: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the farthest corner."""
    return F.array_max(F.transform(ring, lambda p: F.sqrt(F.pow(p["x"] - x, F.lit(2.0)) + F.pow(p["y"] - y, F.lit(2.0)))))


def in_rings(rings: Column, x: Column, y: Column) -> Column:
    """Odd-even test over all rings of a region, holes included."""

    def crosses(e: Column) -> Column:
        up = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]
        return F.when(up & (x < at), 1).otherwise(0)

    n = F.aggregate(rings, F.lit(0), lambda acc, r: acc + F.aggregate(_edges(r), F.lit(0), lambda s, e: s + crosses(e)))
    return n % 2 == 1


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - x1 - t * dx, F.lit(2.0)) + F.pow(y - y1 - t * dy, F.lit(2.0)))


def box_overlap(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Common area of two axis-aligned boxes."""
    w = F.least(ax1, bx1) - F.greatest(ax0, bx0)
    h = F.least(ay1, by1) - F.greatest(ay0, by0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def clip_convex(subject, clip):
    """Corners of a polygon cut to a convex counter-clockwise one (lists of (x, y)), corner by corner."""
    out = list(subject)
    for i in range(len(clip)):
        (ax, ay), (bx, by) = clip[i - 1], clip[i]
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        got = []
        for j in range(len(out)):
            p, q = out[j - 1], out[j]
            sp, sq = side(p), side(q)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                got.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if sq >= 0:
                got.append(q)
        out = got
        if not out:
            break
    return out


def meant_position(lon: Column, lat: Column, west: float, south: float, north: float) -> Column:
    """struct(lon, lat) of a position as meant in an area between `west` and the date line, the strip from there to
    175 W included. Swapped coordinates are turned back, a lost minus sign of the latitude is restored; anything else
    outside the area, and null and NaN, is null."""
    lo, la = lon.cast("double"), lat.cast("double")

    def way(a: Column, b: Column) -> Column:
        ok = ~F.isnan(a) & ~F.isnan(b) & (a.between(west, 180.0) | a.between(-180.0, -175.0)) & b.between(south, north)
        return F.when(ok, F.struct(a.alias("lon"), b.alias("lat")))

    return F.coalesce(way(lo, la), way(la, lo), way(lo, -la), way(la, -lo))
