"""Queries of spatial joins and graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import geo, growth
from grovekit.operators import assignment, graph, spatial
from grovekit.operators import relational as rel
from grovekit.session import current, plain_id, table

c = F.col
ID = "nullif(lower(trim(tree_id, ' ' || chr(9))), '')"
XY = ("tree_id", "x", "y")
XY_SQL = f"xy as (select {ID} tree_id, min(approx_x_m) x, min(approx_y_m) y, min(source_primary) src from trees where approx_x_m is not null and approx_y_m is not null group by 1)"


def points(s: SparkSession, d: str) -> DataFrame:
    """A position and source per tree id."""
    t = table(s, d, "trees").where("approx_x_m is not null and approx_y_m is not null")
    return t.groupBy(plain_id("tree_id").alias("tree_id")).agg(F.min("approx_x_m").alias("x"), F.min("approx_y_m").alias("y"), F.min("source_primary").alias("src"))


def customers(s, d):
    k = c("c_custkey")
    return table(s, d, "customer").select(k.alias("k"), ((k * 7919) % 100003 / 50.0).alias("x"), ((k * 104729) % 100003 / 50.0).alias("y"), c("c_nationkey").alias("nation"), c("c_acctbal").alias("v"), c("c_mktsegment").alias("seg"))


def suppliers(s, d):
    k = c("s_suppkey")
    return table(s, d, "supplier").select(k.alias("k"), ((k * 7919) % 100003 / 50.0).alias("x"), ((k * 15485863) % 100003 / 50.0).alias("y"), c("s_nationkey").alias("nation"))


CUST = "cust as (select c_custkey k, (c_custkey * 7919) % 100003 / 50.0 x, (c_custkey * 104729) % 100003 / 50.0 y, c_nationkey nation, c_acctbal v, c_mktsegment seg from customer)"
SUPP = "supp as (select s_suppkey k, (s_suppkey * 7919) % 100003 / 50.0 x, (s_suppkey * 15485863) % 100003 / 50.0 y, s_nationkey nation from supplier)"


def regions(s, d):
    """25 right triangles of 500 m with a square hole, some over their neighbours."""
    n = c("n_nationkey")
    x, y = (n % 5) * 400.0, F.floor(n / 5) * 400.0
    pt = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.array(pt(0.0, 0.0), pt(500.0, 0.0), pt(0.0, 500.0))
    hole = F.array(pt(50.0, 50.0), pt(100.0, 50.0), pt(100.0, 100.0), pt(50.0, 100.0))
    return table(s, d, "nation").select(n.alias("rid"), F.array(ring, hole).alias("rings"), c("n_regionkey").alias("rank"))


PIP = f"""{CUST}, reg as (select n_nationkey rid, n_regionkey rk, (n_nationkey % 5) * 400.0 x0, (n_nationkey // 5) * 400.0 y0 from nation),
hit as (select k p_id, rid region_id, rk from cust, reg where x >= x0 and y >= y0 and (x - x0) + (y - y0) < 500 and not (x - x0 >= 50 and x - x0 < 100 and y - y0 >= 50 and y - y0 < 100))"""


def nearest_within_radius(s, d):
    return spatial.nearest_within(customers(s, d), suppliers(s, d), ("k", "x", "y"), ("k", "x", "y"), 60.0)


def k2_nearest(s, d):
    p = points(s, d)
    return spatial.k_nearest(p, p, XY, XY, 2, 4.0, 4000.0, skip_self=True).select("a_id", "rank", F.round("d", 6).alias("d"))


def global_nearest(s, d):
    return spatial.k_nearest(customers(s, d), suppliers(s, d), ("k", "x", "y"), ("k", "x", "y"), 1, 50.0, 3000.0).select("a_id", "b_id", F.round("d", 6).alias("d"))


def radius_pairs(s, d):
    return spatial.radius_pairs(points(s, d), XY, 3.0).select("a_id", "b_id")


def cross_source_pairs(s, d):
    p = points(s, d)
    j = spatial.near_join(p, p, XY, XY, 2.0).where(c("a_id") < c("b_id"))
    src = lambda x: p.select(c("tree_id").alias(f"{x}_id"), c("src").alias(f"s{x}"))
    j = j.join(src("a"), "a_id").join(src("b"), "b_id")
    return j.groupBy(F.least("sa", "sb").alias("s1"), F.greatest("sa", "sb").alias("s2")).agg(F.count("*").alias("n"))


def point_in_polygon_all(s, d):
    return spatial.pip_join(customers(s, d), ("k", "x", "y"), regions(s, d), "rid", "rings", 250.0)


def point_in_polygon_smallest(s, d):
    return spatial.pip_join(customers(s, d), ("k", "x", "y"), regions(s, d), "rid", "rings", 250.0, "smallest")


def point_in_polygon_first(s, d):
    return spatial.pip_join(customers(s, d), ("k", "x", "y"), regions(s, d), "rid", "rings", 250.0, "first", "rank")


def point_in_polygon_unique(s, d):
    return spatial.pip_join(customers(s, d), ("k", "x", "y"), regions(s, d), "rid", "rings", 250.0, "unique")


def contained_else_nearest(s, d):
    inside = point_in_polygon_smallest(s, d).withColumn("d", F.lit(0.0))
    rest = customers(s, d).join(inside.select(c("p_id").alias("k")), "k", "left_anti")
    centre = geo.ring_centroid(c("rings")[0])
    near = spatial.nearest_within(rest, regions(s, d).select("rid", centre["x"].alias("x"), centre["y"].alias("y")), ("k", "x", "y"), ("rid", "x", "y"), 700.0)
    return inside.select("p_id", "region_id", "d").unionByName(near.select(c("a_id").alias("p_id"), c("b_id").alias("region_id"), F.round("d", 4).alias("d")))


def count_in_polygons(s, d):
    j = point_in_polygon_all(s, d).groupBy("region_id").agg(F.count("*").alias("n"))
    return regions(s, d).select(c("rid").alias("region_id")).join(j, "region_id", "left").fillna(0, ["n"])


def outside_all_polygons(s, d):
    return customers(s, d).select(c("k").alias("p_id")).join(point_in_polygon_all(s, d).select("p_id").distinct(), "p_id", "left_anti")


def _roads(s, d):
    p = suppliers(s, d)
    return p.select("k", "x", "y", (c("x") + (c("k") % 7) * 20.0).alias("x2"), (c("y") + (c("k") % 5) * 30.0 - 60.0).alias("y2"))


ROADS = "road as (select k, x x1, y y1, x + (k % 7) * 20.0 x2, y + (k % 5) * 30.0 - 60.0 y2 from supp)"
SEGD = "t as (select c.k p_id, r.k seg_id, c.x, c.y, x1, y1, x2, y2, coalesce(least(greatest(((c.x - x1) * (x2 - x1) + (c.y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0), 1), 0) u from cust c, road r), sd as (select p_id, seg_id, sqrt(pow(x - x1 - u * (x2 - x1), 2) + pow(y - y1 - u * (y2 - y1), 2)) d from t)"


def nearest_segment_distance(s, d):
    return spatial.nearest_segment(customers(s, d), ("k", "x", "y"), _roads(s, d), ("k", "x", "y", "x2", "y2"), 80.0, 160.0).select("p_id", "seg_id", F.round("d", 6).alias("d"))


def dwithin_exclude_own(s, d):
    j = spatial.segment_join(customers(s, d), ("k", "x", "y"), _roads(s, d), ("k", "x", "y", "x2", "y2"), 40.0, 160.0)
    own = suppliers(s, d).select(c("k").alias("seg_id"), c("nation").alias("n2"))
    j = j.join(own, "seg_id").join(customers(s, d).select(c("k").alias("p_id"), c("nation").alias("n1")), "p_id").where("n1 <> n2")
    return j.select("p_id", "seg_id", F.round("d", 6).alias("d"))


def _boxes(s, d):
    n = c("n_nationkey")
    x, y = (n % 5) * 400.0, F.floor(n / 5) * 400.0
    b = suppliers(s, d).select("k", "x", "y", (c("x") + 50.0 + c("k") % 60).alias("x1"), (c("y") + 40.0 + c("k") % 90).alias("y1"))
    return table(s, d, "nation").select(n.alias("rid"), x.alias("x0"), y.alias("y0"), (x + 420.0).alias("x1"), (y + 380.0).alias("y1"), c("n_regionkey").alias("kind")), b


BOXES = "a as (select n_nationkey rid, (n_nationkey % 5) * 400.0 x0, (n_nationkey // 5) * 400.0 y0, (n_nationkey % 5) * 400.0 + 420 x1, (n_nationkey // 5) * 400.0 + 380 y1, n_regionkey kind from nation), b as (select k, x, y, x + 50.0 + k % 60 bx1, y + 40.0 + k % 90 by1 from supp), ov as (select rid, k, kind, (least(x1, bx1) - greatest(x0, x)) * (least(y1, by1) - greatest(y0, y)) area, (x1 - x0) * (y1 - y0) fa, (bx1 - x) * (by1 - y) fb from a, b where least(x1, bx1) > greatest(x0, x) and least(y1, by1) > greatest(y0, y))"


def box_overlap_shares(s, d):
    a, b = _boxes(s, d)
    o = spatial.box_overlaps(b, a, ("k", "x", "y", "x1", "y1"), ("rid", "x0", "y0", "x1", "y1"), 200.0)
    return o.select("a_id", "b_id", *[F.round(x, 6).alias(x) for x in ("area", "a_share", "b_share")])


def majority_share(s, d):
    a, b = _boxes(s, d)
    o = spatial.box_overlaps(b, a, ("k", "x", "y", "x1", "y1"), ("rid", "x0", "y0", "x1", "y1"), 200.0)
    o = o.join(a.select(c("rid").alias("b_id"), "kind"), "b_id").withColumn("whole", c("area") / c("a_share"))
    m = spatial.majority_share(o, "a_id", "kind", "area", c("whole"))
    return m.select("a_id", "kind", F.round("share", 6).alias("share"))


def convex_overlay(s, d):
    a, b = _boxes(s, d)
    o = spatial.box_overlaps(b, a, ("k", "x", "y", "x1", "y1"), ("rid", "x0", "y0", "x1", "y1"), 200.0).select("a_id", "b_id")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ra = b.select(c("k").alias("a_id"), F.array(pt(c("x"), c("y")), pt(c("x1"), c("y")), pt(c("x1"), c("y1")), pt(c("x"), c("y1"))).alias("ra"))
    rb = a.select(c("rid").alias("b_id"), F.array(pt(c("x0"), c("y0")), pt(c("x1"), c("y0")), pt(c("x1"), c("y1")), pt(c("x0"), c("y1"))).alias("rb"))
    return spatial.convex_overlaps(o.join(ra, "a_id").join(rb, "b_id"), "a_id", "b_id", "ra", "rb").select("a_id", "b_id", F.round("area", 6).alias("area"))


def ring_measures(s, d):
    r = regions(s, d)
    m = geo.ring_centroid(c("rings")[0])
    return r.select("rid", geo.ring_area(c("rings")[0]).alias("area"), F.round(geo.ring_perimeter(c("rings")[0]), 6).alias("perimeter"), F.round(m["x"], 6).alias("cx"), F.round(m["y"], 6).alias("cy"), F.round(geo.farthest(c("rings")[0], m["x"], m["y"]), 6).alias("spread"))


def competition_metrics(s, d):
    a = table(s, d, "tree_assets_pilot").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.max("height_max_m").alias("h"), F.max("crown_volume_m3").alias("area"))
    p = points(s, d).join(a, "tree_id")
    m = spatial.competition(p, XY, "h", "area")
    return m.select("id", F.round("nearest", 6).alias("nearest"), "n_near", "n_far", F.round("cover_near", 6).alias("cover_near"), F.round("cover_far", 6).alias("cover_far"), F.round("overlap", 6).alias("overlap"), "dominance")


def _suppress(s, d, **kw):
    k = customers(s, d).withColumn("h", (c("k") * 31 % 97) / 4.0)
    return graph.greedy_suppress(k, ("k", "x", "y"), [-c("h")], growth.suppression_radius(c("h"), 10.0, 1.0, 12.0, 40.0), 40.0, **kw)


def greedy_suppress_a(s, d):
    return _suppress(s, d, by="dominator")


def greedy_suppress_b(s, d):
    return _suppress(s, d, by="self")


def greedy_suppress_d(s, d):
    return _suppress(s, d, by="self", strict=True)


def priority_dedup(s, d):
    p = points(s, d)
    rank = F.when(c("src") == "tree_register", 0).when(c("src") == "notable_overlay", 1).when(c("src") == "park_survey", 2).otherwise(3)
    return graph.greedy_suppress(p, XY, [rank], F.lit(1.5), 1.5, always=c("src") == "tree_register")


def components_radius(s, d):
    return graph.components(spatial.radius_pairs(points(s, d), XY, 1.5))


def duplicate_inflation(s, d):
    comp = components_radius(s, d).groupBy("component").agg(F.count("*").alias("n"))
    n = comp.agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.max("n").alias("largest"))
    every = points(s, d).agg(F.count("*").alias("n")).scalar()
    return n.select("clusters", "members", "largest", F.round((c("members") - c("clusters")) / every, 9).alias("inflation"))


def optimal_links(s, d):
    p = assignment.optimal_near(customers(s, d), suppliers(s, d), ("k", "x", "y"), ("k", "x", "y"), 120.0)
    return p.select("l", "r", F.round("cost", 6).alias("cost"), "exact")


def capacity_links(s, d):
    p = assignment.capacity_near(customers(s, d), suppliers(s, d), ("k", "x", "y"), ("k", "x", "y"), 80.0, slots=3, penalty=5.0, null=70.0)
    return p.select("l", "r", F.round("margin", 6).alias("margin"))


def identity_map(s, d):
    """New to old crowns: the largest overlap, and the state of each old crown."""
    l = current(table(s, d, "tree_crown_lineage_v5")).where("intersection_m2 is not null").select("old_seg_key", "new_seg_key", "intersection_m2").distinct()
    best = l.groupBy("old_seg_key").agg(F.max(F.struct("intersection_m2", "new_seg_key")).alias("m")).select("old_seg_key", c("m.new_seg_key").alias("new_seg_key"), c("m.intersection_m2").alias("area"))
    head = best.groupBy("new_seg_key").agg(F.max(F.struct("area", "old_seg_key")).alias("h"), F.count("*").alias("n"))
    j = best.join(head, "new_seg_key")
    return j.select("old_seg_key", "new_seg_key", F.when(c("n") == 1, "matched").otherwise("merged").alias("state"), (c("h.old_seg_key") == c("old_seg_key")).alias("is_primary"))


def link_roles(s, d):
    l = current(table(s, d, "tree_crown_lineage_v5")).where("old_tree_id is not null and intersection_m2 is not null").groupBy("new_seg_key", plain_id("old_tree_id").alias("t")).agg(F.max("intersection_m2").alias("a"))
    g = l.groupBy("new_seg_key").agg(F.max(F.struct("a", "t")).alias("m"), F.count("*").alias("n"))
    j = l.join(g, "new_seg_key")
    role = F.when(c("t") == c("m.t"), "primary").when(c("a") >= c("m.a") * 0.8, "possible_duplicate").otherwise("shares_crown")
    return j.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


def continuity_repair(s, d):
    """Unique dominant candidate of each old crown: enough overlap and a clear margin over the next."""
    l = current(table(s, d, "tree_crown_lineage_v5")).groupBy("old_seg_key", "new_seg_key").agg(F.max("old_fraction").alias("f"), F.max("new_fraction").alias("g"))
    # only the two best options of a crown travel, however many it has
    r = rel.top_k(l.where("f is not null and g is not null"), ["old_seg_key"], [c("f").desc(), c("new_seg_key").desc()], 2)
    at = lambda k, x: F.max(F.when(c("rank") == k, c(x)))
    a = r.groupBy("old_seg_key").agg(at(1, "f").alias("f1"), at(2, "f").alias("f2"), at(1, "g").alias("g1"), at(1, "new_seg_key").alias("new_seg_key"))
    verdict = F.when(c("f1") < 0.5, "too_small").when(c("f1") - c("f2") < 0.2, "competitor").when(c("g1") < 0.1, "tiny_share").otherwise("accept")
    return a.select("old_seg_key", "new_seg_key", verdict.alias("verdict"))


QUERIES = {f.__name__: f for f in (
    nearest_within_radius, k2_nearest, global_nearest, radius_pairs, cross_source_pairs, point_in_polygon_all, point_in_polygon_smallest, point_in_polygon_first,
    point_in_polygon_unique, contained_else_nearest, count_in_polygons, outside_all_polygons, nearest_segment_distance, dwithin_exclude_own, box_overlap_shares, majority_share,
    convex_overlay, ring_measures, competition_metrics, greedy_suppress_a, greedy_suppress_b, greedy_suppress_d, priority_dedup, components_radius, duplicate_inflation,
    optimal_links, capacity_links, identity_map, link_roles, continuity_repair,
)}

_D = "sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2))"
_NEAR = lambda r: f"nn as (select c.k a_id, s.k b_id, {_D} d from cust c, supp s where {_D} <= {r} qualify row_number() over (partition by c.k order by {_D}, s.k) = 1)"
_XD = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
def _sequential(test: str) -> str:
    """Greedy suppression as a loop over the items in priority order that carries the kept ones."""
    return f"""with recursive {CUST}, o as (select k, x, y, least(greatest((k * 31 % 97) / 4.0 + 10, 12), 40)::double r, row_number() over (order by (k * 31 % 97) desc, k) n from cust),
s(n, kept) as (select 0::bigint, []::struct(k bigint, x double, y double, r double)[] union all select o.n, case when len(list_filter(s.kept, lambda q: {test})) > 0 then s.kept else list_append(s.kept, struct_pack(k := o.k, x := o.x::double, y := o.y::double, r := o.r)) end from s join o on o.n = s.n + 1)
select unnest(kept).k id from (select kept from s order by n desc limit 1)"""


_QD = "sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y))"
_L4 = "select distinct old_seg_key, new_seg_key, intersection_m2 from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5) and intersection_m2 is not null"
SQL = {
    "nearest_within_radius": f"with {CUST}, {SUPP}, {_NEAR(60)} select * from nn",
    "global_nearest": f"with {CUST}, {SUPP}, {_NEAR(3000)} select a_id, b_id, round(d, 6) d from nn",
    "k2_nearest": f"with {XY_SQL}, p as (select a.tree_id a_id, {_XD} d, row_number() over (partition by a.tree_id order by {_XD}, b.tree_id)::int as rank from xy a join xy b on a.tree_id <> b.tree_id) select a_id, rank, round(d, 6) d from p where rank <= 2",
    "radius_pairs": f"with {XY_SQL} select a.tree_id a_id, b.tree_id b_id from xy a join xy b on a.tree_id < b.tree_id and {_XD} <= 3",
    "cross_source_pairs": f"with {XY_SQL} select least(a.src, b.src) s1, greatest(a.src, b.src) s2, count(*) n from xy a join xy b on a.tree_id < b.tree_id and {_XD} <= 2 group by 1, 2",
    "point_in_polygon_all": f"with {PIP} select p_id, region_id from hit",
    "point_in_polygon_smallest": f"with {PIP} select p_id, min(region_id) region_id from hit group by 1",
    "point_in_polygon_first": f"with {PIP} select p_id, first(region_id order by rk, region_id) region_id from hit group by 1",
    "point_in_polygon_unique": f"with {PIP} select p_id, min(region_id) region_id from hit group by 1 having count(*) = 1",
    "count_in_polygons": f"with {PIP} select rid region_id, count(p_id) n from reg left join hit on rid = region_id group by 1",
    "outside_all_polygons": f"with {PIP} select k p_id from cust where k not in (select p_id from hit)",
    "nearest_segment_distance": f"with {CUST}, {SUPP}, {ROADS}, {SEGD} select p_id, seg_id, round(d, 6) d from sd where d <= 80 qualify row_number() over (partition by p_id order by d, seg_id) = 1",
    "dwithin_exclude_own": f"with {CUST}, {SUPP}, {ROADS}, {SEGD} select p_id, seg_id, round(d, 6) d from sd join cust on cust.k = p_id join supp on supp.k = seg_id where d <= 40 and cust.nation <> supp.nation",
    "box_overlap_shares": f"with {SUPP}, {BOXES} select k a_id, rid b_id, round(area, 6)::double area, round(area / fb, 6) a_share, round(area / fa, 6) b_share from ov where area >= 0.25",
    "majority_share": f"with {SUPP}, {BOXES}, g as (select k, kind, sum(area) s, max(fb) w from ov where area >= 0.25 group by 1, 2) select k a_id, kind, round(least(s / w, 1), 6) share from g qualify row_number() over (partition by k order by s desc, kind desc) = 1",
    "convex_overlay": f"with {SUPP}, {BOXES} select k a_id, rid b_id, round(area, 6)::double area from ov where area >= 0.25",
    "ring_measures": "select n_nationkey rid, 125000.0::double area, round(1000 + sqrt(500000), 6) perimeter, round((n_nationkey % 5) * 400 + 500 / 3, 6) cx, round((n_nationkey // 5) * 400 + 500 / 3, 6) cy, round(sqrt(pow(1000 / 3, 2) + pow(500 / 3, 2)), 6) spread from nation",
    "competition_metrics": f"""with {XY_SQL}, a as (select {ID} tree_id, max(height_max_m) h, max(crown_volume_m3) s from tree_assets_pilot group by 1), p as (select xy.tree_id, x, y, h, s from xy join a using (tree_id)),
q as (select a.tree_id id, {_XD} d, a.h ha, b.h hb, a.s sa, b.s sb from p a join p b on a.tree_id <> b.tree_id and abs(a.x - b.x) <= 50 and abs(a.y - b.y) <= 50 and {_XD} <= 50),
g as (select id, min(d) nearest, count(*) filter (where d <= 25) n_near, count(*) n_far, sum(sb) filter (where d <= 25) s_near, sum(sb) s_far, count(*) filter (where d <= 25 and sqrt(greatest(coalesce(sa, 1e-6), 1e-6) / pi()) + sqrt(greatest(coalesce(sb, 1e-6), 1e-6) / pi()) > d) n_over, count(*) filter (where d <= 25 and hb > ha) n_taller from q group by 1)
select p.tree_id id, round(nearest, 6) nearest, coalesce(n_near, 0) n_near, coalesce(n_far, 0) n_far, round(least(1, coalesce(s_near, 0) / (pi() * 625)), 6) cover_near, round(least(1, coalesce(s_far, 0) / (pi() * 2500)), 6) cover_far,
 round(coalesce(n_over, 0) / greatest(coalesce(n_near, 0), 1), 6) overlap, case when coalesce(n_near, 0) = 0 or n_taller / n_near <= 0.2 then 'dominant' when n_taller / n_near >= 0.7 then 'suppressed' else 'co-dominant' end dominance from p left join g on p.tree_id = g.id""",
    "components_radius": f"with recursive {XY_SQL}, e as (select a.tree_id u, b.tree_id v from xy a join xy b on a.tree_id <> b.tree_id and {_XD} <= 1.5), r(u, v) as (select u, u from e union select r.u, e.v from r join e on r.v = e.u) select u id, min(v) component from r group by 1",
    "identity_map": f"with l as ({_L4}), b as (select * from l qualify row_number() over (partition by old_seg_key order by intersection_m2 desc, new_seg_key desc) = 1) select old_seg_key, new_seg_key, case when count(*) over (partition by new_seg_key) = 1 then 'matched' else 'merged' end state, row_number() over (partition by new_seg_key order by intersection_m2 desc, old_seg_key desc) = 1 is_primary from b",
    "link_roles": f"with l as (select new_seg_key, {ID.replace('tree_id', 'old_tree_id')} t, max(intersection_m2) a from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5) and old_tree_id is not null and intersection_m2 is not null group by 1, 2), m as (select *, row_number() over (partition by new_seg_key order by a desc, t desc) i, max(a) over (partition by new_seg_key) top from l) select case when i = 1 then 'primary' when a >= top * 0.8 then 'possible_duplicate' else 'shares_crown' end role, count(*) n from m group by 1",
    "continuity_repair": "with l as (select old_seg_key, new_seg_key, max(old_fraction) f, max(new_fraction) g from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5) group by 1, 2), r as (select *, row_number() over w i, lead(f) over w f2 from l where f is not null and g is not null window w as (partition by old_seg_key order by f desc, new_seg_key desc)) select old_seg_key, new_seg_key, case when f < 0.5 then 'too_small' when f2 is not null and f - f2 < 0.2 then 'competitor' when g < 0.1 then 'tiny_share' else 'accept' end verdict from r where i = 1",
    "contained_else_nearest": f"with {PIP}, a as (select p_id, min(region_id) region_id from hit group by 1), n as (select k p_id, rid region_id, sqrt(pow(x - x0 - 500 / 3, 2) + pow(y - y0 - 500 / 3, 2)) d from cust, reg where k not in (select p_id from a)) select p_id, region_id, 0.0::double d from a union all select p_id, region_id, round(d, 4) d from (select * from n where d <= 700 qualify row_number() over (partition by p_id order by d, region_id) = 1)",
    "duplicate_inflation": f"with recursive {XY_SQL}, e as (select a.tree_id u, b.tree_id v from xy a join xy b on a.tree_id <> b.tree_id and {_XD} <= 1.5), r(u, v) as (select u, u from e union select r.u, e.v from r join e on r.v = e.u), c as (select u, min(v) c from r group by 1), g as (select c, count(*) n from c group by 1) select count(*) clusters, sum(n)::bigint members, max(n) largest, round((sum(n) - count(*)) / (select count(*) from xy), 9)::double inflation from g",
    "greedy_suppress_a": _sequential(f"{_QD} <= q.r"),
    "greedy_suppress_b": _sequential(f"{_QD} <= o.r"),
    "greedy_suppress_d": _sequential(f"{_QD} < o.r"),
}
