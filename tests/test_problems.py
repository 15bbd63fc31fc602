"""Snapshot changes, orphan references and proximity against brute force, and their edge cases."""

import datetime as dt
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovekit.functions.bitmaps import Bitmap
from grovekit.functions.triangles import TopTree, ear_clip, hits, in_triangles, signed_area
from grovekit.operators import proximity
from grovekit.operators.references import orphan_references, orphan_report
from grovekit.operators.snapshots import key_ordinals, snapshot_changes
from grovekit.session import plain_id


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=200), st.sets(st.integers(0, 300_000), max_size=200), st.integers(0, 2))
def test_bitmaps(a, b, dense):
    a |= set(range(70_000, 70_000 + dense * 6_000))
    b |= set(range(72_000, 72_000 + dense * 5_000))
    x, y = Bitmap.of(np.array(sorted(a), dtype=np.int64)), Bitmap.of(np.array(sorted(b), dtype=np.int64))
    assert x.and_(y).ordinals().tolist() == sorted(a & b) and x.and_not(y).ordinals().tolist() == sorted(a - b) and len(x) == len(a)


def changes(df, **kw):
    return {tuple(r) for r in snapshot_changes(df, ["k"], {"t": plain_id("t")}, ["v"], **kw).collect()}


SNAP = "snapshot_no int, k string, t string, v double, bucket string, ordinal string, p0 string"


def test_snapshot_changes(spark):
    rows = [
        (1, "same", " A\t", 1.0), (1, "same", "a", 1.0), (2, "same", "A", 1.0 + 4e-7), (3, "same", "a", 1.0),
        (1, "gone", "x", 1.0), (2, "new", "x", 1.0), (3, "new", "y", 1.0), (1, "num", "x", 1.0), (2, "num", "x", 1.001), (3, "num", "x", 1.001),
        (1, "null", None, None), (2, "null", None, None), (3, "null", None, 2.0), (1, None, "n", 1.0), (2, None, "n", 1.0), (3, None, "m", 1.0),
        (None, "lost", "x", 1.0), (1, "nan", "x", float("nan")), (2, "nan", "x", None), (3, "nan", "x", float("nan")),
    ]
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SNAP)
    want = {(2, "gone", "removed"), (2, "new", "added"), (3, "new", "changed"), (2, "num", "changed"), (3, "null", "changed"), (3, None, "changed")}
    assert changes(df) == want == changes(df, group_keys=1) == changes(df, slots=2, group_keys=2)


def test_snapshot_blocks_and_empty(spark):
    rows = [(i, f"k{j}", "t", float(i // (j + 1))) for i in range(70) for j in range(4) if (i + j) % 5]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SNAP)
    by = {}
    for s, k, _, v in rows:
        by.setdefault(s, {})[k] = v
    want = set()
    for a, b in zip(range(69), range(1, 70)):
        want |= {(b, k, "added") for k in by[b].keys() - by[a].keys()} | {(b, k, "removed") for k in by[a].keys() - by[b].keys()}
        want |= {(b, k, "changed") for k in by[a].keys() & by[b].keys() if by[a][k] != by[b][k]}
    assert changes(df) == want
    assert changes(df.limit(0)) == set() and changes(df.where("snapshot_no = 3")) == set()


def test_ordinals_persist(spark):
    rows = [(n, f"k{i:03d}") for n in range(1, 5) for i in range(n * 20, n * 20 + 60)] + [(None, "lost"), (2, None), (1, "k020")]
    df = spark.createDataFrame(rows, "snapshot_no int, k string").withColumn("ordinal", F.lit("clash"))
    take = lambda d, **kw: {r["k"]: r["ordinal"] for r in key_ordinals(d, ["k"], slots=4, **kw).collect()}
    first, every = take(df.where("snapshot_no < 4")), take(df.repartition(7))
    assert len(set(every.values())) == len(every) == len({r[1] for r in rows}) - 1
    # a further snapshot, or another run, moves no ordinal
    assert all(every[k] == o for k, o in first.items()) and take(df) == every
    # nor does the loss of the earlier deliveries where the table was stored
    kept = key_ordinals(df.where("snapshot_no < 4"), ["k"], slots=4)
    later = take(df.where("snapshot_no = 4"), known=kept)
    assert all(later[k] == o for k, o in first.items()) and len(set(later.values())) == len(every)


def test_whole_numbers_are_compared_exactly(spark):
    rows = [(n, k, v + d) for n, d in ((1, 0), (2, 1)) for k, v in (("far", 2**60), ("near", 5))] + [(1, "null", None), (2, "null", 0), (1, "same", 2**62), (2, "same", 2**62)]
    df = spark.createDataFrame(rows, "snapshot_no int, k string, v long")
    want = {(2, "far", "changed"), (2, "near", "changed"), (2, "null", "changed")}
    assert {tuple(r) for r in snapshot_changes(df, ["k"], {}, ["v"]).collect()} == want == {tuple(r) for r in snapshot_changes(df, ["k"], {"v": F.col("v")}).collect()}


def test_orphans(spark):
    t = lambda m, d: dt.datetime(2024, m, d)
    p = spark.createDataFrame([("A ", t(2, 1), None), ("a", t(3, 1), t(6, 15)), ("b", t(1, 1), None)], "tree_id string, loaded_at timestamp, retired_at timestamp")
    rows = [(" a", t(1, 31)), ("A", t(2, 1)), ("a", t(6, 14)), ("a", t(6, 15)), ("a", t(7, 1)), ("c", t(1, 1)), ("c", t(1, 1)), (None, t(1, 1)), ("b", None), ("d", None), ("", t(1, 1))]
    ch = spark.createDataFrame(rows, "tree_id string, created_at_utc timestamp").withColumn("key", F.lit(1)).withColumn("kind", F.lit(1))
    o = orphan_references({"x": (ch, plain_id("tree_id"), F.col("created_at_utc")), "y": (ch.limit(0), plain_id("tree_id"), F.col("created_at_utc"))}, p, plain_id("tree_id"), F.col("loaded_at"), F.col("retired_at"))
    got = {(r["key"], r["period"], r["kind"], r["n_rows"]) for r in o.collect()}
    assert got == {("a", "2024-01", "late", 1), ("a", "2024-06", "deleted", 2), ("a", "2024-07", "deleted", 1), ("c", "2024-01", "missing", 2), ("d", None, "missing", 1)}
    assert {(r["kind"], r["n_keys"]) for r in orphan_report(o).where("period = '2024-01'").collect()} == {("late", 1), ("missing", 1)}
    none = orphan_references({"x": (ch, plain_id("tree_id"), F.col("created_at_utc"))}, p.limit(0), plain_id("tree_id"), F.col("loaded_at"), F.col("retired_at"))
    assert {r["kind"] for r in none.collect()} == {"missing"}


def test_heavy_keys_take_the_broadcast_path(spark):
    """A key with a third of 60,000 referring rows in three months: few rows once aggregated, heavy all the same."""
    p = spark.createDataFrame([("hot", dt.datetime(2020, 2, 1))], "k string, born timestamp").withColumn("died", F.lit(None).cast("timestamp"))
    at = F.expr("timestampadd(MONTH, cast(id % 3 as int), timestamp'2020-01-01')").alias("at")
    rest = spark.range(40_000).select(F.concat(F.lit("k"), F.col("id") % 20_000).alias("k"), at)
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), at)
    find = lambda df: orphan_references({"x": (df, F.col("k"), F.col("at"))}, p, F.col("k"), F.col("born"), F.col("died"))
    hints = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")
    o = find(hot.unionByName(rest))
    got = {(r["kind"], r["n"]) for r in o.groupBy("kind").agg(F.sum("n_rows").alias("n")).collect()}
    assert got == {("late", 6667), ("missing", 40_000)}
    assert hints(o) >= 3 and hints(find(rest)) == 0


def star(rnd, n):
    a = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [(math.cos(x) * r, math.sin(x) * r) for x, r in ((x, rnd.uniform(0.3, 2)) for x in a)]


def ray(p, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_ear_clipping_tiles_the_ring():
    rnd = random.Random(3)
    for n in range(3, 40):
        ring = star(rnd, n)
        if max(b - a for a, b in zip(sorted(math.atan2(y, x) for x, y in ring), sorted(math.atan2(y, x) for x, y in ring)[1:])) > 3:
            continue
        t = ear_clip(ring)
        assert abs(sum(abs(signed_area(x)) for x in t) - abs(signed_area(np.array(ring)))) < 1e-9
        p = np.array([(rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for _ in range(60)])
        assert in_triangles(p, t).any(axis=1).tolist() == [ray(q, ring) for q in p]
    assert len(ear_clip([])) == len(ear_clip([(0, 0), (1, 1), (2, 2)])) == len(ear_clip([(0, 0)] * 5)) == 0
    assert len(ear_clip([(0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0)])) == 2


def test_hierarchies_equal_brute_force():
    rnd = np.random.default_rng(4)
    p = rnd.random((500, 2))
    t = np.array([x for _ in range(200) for x in ear_clip(rnd.random(2) + rnd.random((3, 2)) * 0.1)])
    want = {tuple(x) for x in np.argwhere(in_triangles(p, t))}
    assert set(zip(*[x.tolist() for x in hits(p, t)])) == want
    tree = TopTree(np.concatenate([p, p, [[0.5, 0.5]] * 100]), 20)
    leaf = tree.leaf_of(p)
    who, leaves = tree.leaves_of(np.concatenate([t.min(axis=1), t.max(axis=1)], axis=1))
    reach = set(zip(who.tolist(), leaves.tolist()))
    assert all((j, int(leaf[i])) in reach for i, j in want)


def test_near_points_equal_brute_force(spark):
    rnd = random.Random(5)
    pos = lambda: (174.3 + rnd.uniform(0, 6e-4), -37.2 + rnd.uniform(0, 5e-4))
    cs = [(f"c{i}", *pos()) for i in range(120)] + [("c0", None, -37.2), ("bad", 0.0, 0.0), (None, 174.3, -37.2), ("east", 179.99999, -17.0)]
    os_ = [(f"t{i}", *pos()) for i in range(200)] + [("t0", 9999.0, -9999.0), ("nan", float("nan"), 1.0), ("west", -179.99999, -17.0)]
    os_ += os_[:20]
    c = spark.createDataFrame(cs, "candidate_id string, lon double, lat double").withColumn("tri", F.lit(1)).withColumn("part", F.lit(1))
    o = spark.createDataFrame(os_, "tree_id string, lon double, lat double").withColumn("other_id", F.lit("x"))

    def metres(a, b):
        la, lb = math.radians(a[2]), math.radians(b[2])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * proximity.EARTH_M * math.asin(math.sqrt(h))

    ok = lambda x: x[0] is not None and x[1] is not None and x[1] == x[1] and abs(x[1]) <= 180 and x[1] != 0
    want = {(a[0], b[0]) for a in cs for b in os_ if ok(a) and ok(b) and metres(a, b) <= 5}
    got = proximity.near_points(c, F.col("candidate_id"), o, F.col("tree_id"), 5.0).collect()
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(want) > 50 and ("east", "west") in want
    assert proximity.near_points(c.limit(0), F.col("candidate_id"), o, F.col("tree_id"), 5.0).count() == 0
    assert proximity.near_points(c, F.col("candidate_id"), o.limit(0), F.col("tree_id"), 5.0).count() == 0


def test_crowded_leaves_are_split(spark):
    p = spark.range(900).select(F.concat(F.lit("p"), "id").alias("pid"), F.lit(0.5).alias("x"), F.lit(0.25).alias("y"))
    t = spark.range(60).select(F.col("id").alias("rid"), F.lit(0).alias("part"), F.array(*[F.lit(float(v)) for v in (0, 0, 1, 0, 1, 1)]).alias("tri"))
    got = proximity.points_in_triangles(p, "x", "y", ["pid"], t, ["rid"], leaf_rows=50)
    assert got.count() == got.distinct().count() == 900 * 60


def test_regions_with_holes(spark):
    rnd = random.Random(6)
    ring, hole = star(rnd, 14), [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]
    st_ = "rid int, rings array<array<struct<x:double,y:double>>>"
    reg = spark.createDataFrame([(1, [ring, hole]), (2, [[(5.0, 5.0), (6.0, 5.0)]]), (3, None)], st_)
    pts = [(i, rnd.uniform(-2, 2), rnd.uniform(-2, 2)) for i in range(300)] + [(999, None, 1.0)]
    got = {(r[0], r[1]) for r in proximity.points_in_regions(spark.createDataFrame(pts, "pid int, x double, y double"), "pid", "x", "y", reg, "rid", "rings").collect()}
    assert got == {(i, 1) for i, x, y in pts if x is not None and ray((x, y), ring) and not ray((x, y), hole)}
