"""Queries composed of several operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import text
from grovekit.operators import graph
from grovekit.operators import relational as rel
from grovekit.operators import spatial as sp
from grovekit.operators import survey as op
from grovekit.plans.spatial import CUST, ID, PIP, SUPP, XY, XY_SQL, customers, points, regions, suppliers
from grovekit.plans.survey import CELLS, HT, _cells, _heights
from grovekit.session import current, plain_id, table

c = F.col


def alias_lookup(s: SparkSession, d: str) -> DataFrame:
    """Latin name of a common name: by the whole name, else by its first word."""
    r = table(s, d, "itree_species_ref").where("common_name is not null")
    whole = r.groupBy(F.lower("common_name").alias("k")).agg(F.min("scientific_name").alias("latin"))
    first = r.groupBy(F.split(F.lower("common_name"), " ")[0].alias("k")).agg(F.min("scientific_name").alias("latin"))
    t = table(s, d, "trees").select(F.lower(text.clean_text(c("species_common"))).alias("name")).where("name is not null").distinct()
    return rel.fallback_lookup(t, [(c("name"), whole, "k", "latin", "name"), (F.split("name", " ")[0], first, "k", "latin", "first_word")], "latin", F.lit(None).cast("string"))


def segmentation_scores(s, d):
    l = current(table(s, d, "tree_crown_lineage_v5")).groupBy("old_seg_key", "new_seg_key").agg(F.max("intersection_m2").alias("a"), F.max("old_fraction").alias("o"), F.max("new_fraction").alias("n"))
    r = op.segmentation_scores(l, "old_seg_key", "new_seg_key", "a", "o", "n")
    return r.select("n", *[F.round(x, 9).alias(x) for x in ("recall", "split", "merge", "iou", "objective")])


def otsu_thresholds(s, d):
    return op.otsu(table(s, d, "tree_assets_pilot"), ["growth_setting"], "height_max_m")


def smoothed_cells(s, d):
    r = op.smooth(_cells(s, d))
    return r.select("i", "j", F.round("h", 6).alias("h"))


def despiked_cells(s, d):
    r = op.despike(_cells(s, d))
    return r.select("i", "j", F.round("h", 6).alias("h"))


def saddles(s, d):
    h = _heights(s, d).where("h > 10").select("tree_id", "x", "y", "h")
    p = sp.radius_pairs(h, XY, 12.0).select("a_id", "b_id")
    p = p.join(h.select(c("tree_id").alias("a_id"), c("x").alias("xa"), c("y").alias("ya"), c("h").alias("ha")), "a_id").join(h.select(c("tree_id").alias("b_id"), c("x").alias("xb"), c("y").alias("yb"), c("h").alias("hb")), "b_id")
    r = op.saddle_share(p, ("xa", "ya", "ha"), ("xb", "yb", "hb"), _cells(s, d), 10.0)
    return r.select("a_id", "b_id", F.round("saddle", 6).alias("saddle"), (c("saddle") >= 0.7).alias("one_crown"))


def merge_clusters(s, d):
    h = _heights(s, d).withColumn("rank", F.when(c("src") == "tree_register", 0).otherwise(1))
    return op.merge_clusters(h, XY, _cells(s, d, 3.0), 3.0, c("rank"), "h0", 6.0).select("id", "cluster", "size", "merge_class", "is_primary")


def candidate_audit(s, d):
    """Detected trees each record could be: within 6 m, or linked by lineage, with what speaks for it."""
    p = points(s, d)
    near = sp.near_join(p.where("src not like 'lidar%'"), p.where("src like 'lidar%'"), XY, XY, 6.0).select(c("a_id").alias("tree_id"), c("b_id").alias("candidate"), F.lit(1).alias("near"))
    m = table(s, d, "tree_crown_merge_pilot").select(plain_id("primary_tree_id").alias("tree_id"), plain_id("member_tree_id").alias("candidate"), F.lit(1).alias("linked")).where("tree_id is not null and candidate is not null and tree_id <> candidate").distinct()
    j = near.join(m, ["tree_id", "candidate"], "full")
    why = rel.reasons([(c("near") == 1, "near"), (c("linked") == 1, "linked")], "+")
    return j.groupBy(why.alias("basis")).agg(F.count("*").alias("n"))


def canonical_inventory(s, d):
    """One schema and one record per standing tree: cleaned names, classes, and priority dedup within 6 m."""
    from grovekit.functions.geo import meant_position, to_grid

    at = meant_position(c("lon"), c("lat"), 160.0, -55.0, -25.0)
    p = table(s, d, "nz_tree_points").withColumn("at", at).where("at is not null")
    g = to_grid(c("at.lon"), c("at.lat"))
    p = p.select("point_id", "source_slug", c("source_priority").try_cast("int").alias("rank"), text.clean_text(c("common_name")).alias("common"), text.clean_text(c("scientific_name")).alias("latin"), text.species_confidence(c("common_name"), c("scientific_name")).alias("scope"), g["x"].alias("x"), g["y"].alias("y"))
    kept = graph.greedy_suppress(p, ("point_id", "x", "y"), [F.coalesce(c("rank"), F.lit(99))], F.lit(6.0), 6.0)
    return p.join(kept.select(c("id").alias("point_id")), "point_id").groupBy("source_slug", "scope").agg(F.count("*").alias("n"), F.count("common").alias("n_common"), F.count("latin").alias("n_latin"))


def context_join(s, d):
    """Each point with its region, nearest facility within 100 m, whether a road or a flow path runs within 40 m, and
    the temperature of the grid cell that holds it (else of the nearest cell within 300 m)."""
    o = customers(s, d)
    k = c("s_suppkey")
    lines = table(s, d, "supplier").select(k.alias("k"), ((k * 7919) % 100003 / 50.0).alias("x1"), ((k * 15485863) % 100003 / 50.0).alias("y1"), ((k * 7919) % 100003 / 50.0 + (k % 5 - 2) * 90).alias("x2"), ((k * 15485863) % 100003 / 50.0 + (k % 7 - 3) * 80).alias("y2"), (k % 3 == 0).alias("flow"))
    beside = lambda l: sp.segment_join(o, ("k", "x", "y"), l, ("k", "x1", "y1", "x2", "y2"), 40.0, 100.0).select(c("p_id").alias("k")).distinct()
    road, flow = beside(lines.where("not flow")).withColumn("road_40m", F.lit(True)), beside(lines.where("flow")).withColumn("flow_path_40m", F.lit(True))
    grid = o.groupBy(F.floor(c("x") / 200).alias("i"), F.floor(c("y") / 200).alias("j")).agg(F.max("v").alias("t")).where("(i + j) % 3 <> 0")
    cells = grid.select(F.concat_ws("_", "i", "j").alias("cell"), ((c("i") + 0.5) * 200).alias("x"), ((c("j") + 0.5) * 200).alias("y"), "t")
    inside = o.select("k", F.floor(c("x") / 200).alias("i"), F.floor(c("y") / 200).alias("j")).join(grid, ["i", "j"], "left").select("k", "t")
    away = sp.near_join(o.join(inside.where("t is null").select("k"), "k", "left_semi"), cells, ("k", "x", "y"), ("cell", "x", "y"), 300.0, (), ("t",))
    away = away.groupBy(c("a_id").alias("k")).agg(F.min(F.struct("d", "b_id", "b_t"))["b_t"].alias("t2"))
    reg = sp.pip_join(o, ("k", "x", "y"), regions(s, d), "rid", "rings", 250.0, "smallest").select(c("p_id").alias("k"), "region_id")
    near = sp.nearest_within(o, suppliers(s, d), ("k", "x", "y"), ("k", "x", "y"), 100.0).select(c("a_id").alias("k"), c("b_id").alias("facility"), F.round("d", 6).alias("facility_m"))
    full = o.select("k")
    for part in (reg, near, road, flow, inside, away):
        full = full.join(part, "k", "left")
    return full.select("k", "region_id", "facility", "facility_m", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("road_40m", "flow_path_40m")], F.coalesce("t", "t2").alias("temperature"))


def impervious_fraction(s, d):
    """Share of the 30 m box around each point that sealed boxes cover, at most 1."""
    o = customers(s, d).select("k", (c("x") - 15).alias("x0"), (c("y") - 15).alias("y0"), (c("x") + 15).alias("x1"), (c("y") + 15).alias("y1"))
    b = suppliers(s, d).select("k", "x", "y", (c("x") + 50.0 + c("k") % 60).alias("x1"), (c("y") + 40.0 + c("k") % 90).alias("y1"))
    ov = sp.box_overlaps(o, b, ("k", "x0", "y0", "x1", "y1"), ("k", "x", "y", "x1", "y1"), 100.0, 0.0)
    g = ov.where("area > 0").groupBy(c("a_id").alias("k")).agg(F.round(F.least(F.sum("a_share"), F.lit(1.0)), 6).alias("sealed"))
    return o.select("k").join(g, "k", "left").fillna(0.0, ["sealed"])


def identity_build(s, d):
    """Unique links of old trees to new crowns, the primary of each crown, and ids for crowns without one."""
    l = current(table(s, d, "tree_crown_lineage_v5")).select("new_seg_key", plain_id("old_tree_id").alias("t"), "intersection_m2").distinct()
    one = l.where("t is not null").groupBy("t").agg(F.count_distinct("new_seg_key").alias("n"), F.max(F.struct(F.coalesce("intersection_m2", F.lit(0.0)).alias("a"), "new_seg_key")).alias("m")).where("n = 1").select("t", c("m.new_seg_key").alias("new_seg_key"), c("m.a").alias("a"))
    prim = one.groupBy("new_seg_key").agg(F.max(F.struct("a", "t"))["t"].alias("primary_id"))
    k = l.select("new_seg_key").distinct().join(prim, "new_seg_key", "left")
    new = F.concat(F.lit("tree_"), F.substring(F.sha2("new_seg_key", 256), 1, 20))
    return k.select("new_seg_key", F.coalesce("primary_id", new).alias("tree_id"), c("primary_id").isNull().alias("is_new"))


def current_state(s, d):
    """Current rows with their display role, and the earlier detections that no current row covers."""
    t = table(s, d, "trees").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.max("loaded_at").alias("at"), F.max("retired_at").alias("gone"), F.min("record_role").alias("role"))
    live = t.where("gone is null").select("tree_id", "role")
    old = t.where("gone is not null").select("tree_id", "gone")
    u = rel.union_versions(live, old)
    show = F.when(c("is_current") == 0, "earlier_detection").when(c("role") == "remote_sensing_detection", "detection").otherwise("record")
    return u.groupBy(show.alias("display_role")).agg(F.count("*").alias("n"))


def confidence_model(s, d):
    """Logistic confidence that an overlap is a crown's continuation, trained on four of five folds of its keys."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    l = current(table(s, d, "tree_crown_lineage_v5")).where("intersection_m2 is not null and old_fraction is not null and new_fraction is not null")
    l = l.groupBy("new_seg_key", "old_seg_key").agg(F.max("intersection_m2").alias("a"), F.max("old_fraction").alias("o"), F.max("new_fraction").alias("n"))
    top = l.groupBy("new_seg_key").agg(F.max(F.struct("a", "old_seg_key"))["old_seg_key"].alias("best"))
    x = l.join(top, "new_seg_key").withColumn("label", (c("old_seg_key") == c("best")).cast("double")).withColumn("fold", op.fold_of(c("new_seg_key")))
    v = VectorAssembler(inputCols=["o", "n"], outputCol="features").transform(x)
    m = LogisticRegression(regParam=0.01, maxIter=30).fit(v.where("fold <> 0"))
    r = op.binary_scores(m.transform(v.where("fold = 0")), c("label") == 1, c("prediction") == 1)
    return r.select("n", *[F.round(z, 4).alias(z) for z in ("precision", "recall", "f1")])


def adjusted_priors(s, d):
    p = table(s, d, "tree_root_zone_pilot").where("model_confidence is not null").select(plain_id("tree_id").alias("tree_id"), F.coalesce(c("model_confidence").try_cast("double"), F.lit(0.5)).alias("p"))
    return p.select("tree_id", F.round(op.prior_adjusted(c("p"), 0.5, 0.2), 9).alias("p")).distinct()


def rooftop_anti_join(s, d):
    """Points that stand in no sealed box."""
    b = suppliers(s, d)
    ring = F.array(*[F.struct((c("x") + a).cast("double").alias("x"), (c("y") + e).cast("double").alias("y")) for a, e in ((0, 0), (40, 0), (40, 40), (0, 40))])
    hit = sp.pip_join(customers(s, d), ("k", "x", "y"), b.select("k", F.array(ring).alias("rings")), "k", "rings", 80.0)
    return customers(s, d).select(c("k").alias("p_id")).join(hit.select("p_id").distinct(), "p_id", "left_anti")


QUERIES = {f.__name__: f for f in (
    alias_lookup, segmentation_scores, otsu_thresholds, smoothed_cells, despiked_cells, saddles, merge_clusters, candidate_audit, canonical_inventory, context_join,
    impervious_fraction, identity_build, current_state, confidence_model, adjusted_priors, rooftop_anti_join,
)}

_CL = "case when lower(trim(regexp_replace(species_common, '\\s+', ' ', 'g'))) in ('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', '<blank>') then null else lower(trim(regexp_replace(species_common, '\\s+', ' ', 'g'))) end"
_OFF = "o as (select a::bigint a, b::bigint b from (select unnest([-1, 0, 1]) a), (select unnest([-1, 0, 1]) b))"
SQL = {
    "alias_lookup": f"with t as (select distinct {_CL} n from trees), w as (select lower(common_name) k, min(scientific_name) l from itree_species_ref where common_name is not null group by 1), f as (select split_part(lower(common_name), ' ', 1) k, min(scientific_name) l from itree_species_ref where common_name is not null group by 1) select n as name, coalesce(w.l, f.l) latin, case when w.l is not null then 'name' when f.l is not null then 'first_word' else 'model' end latin_source from t left join w on n = w.k left join f on split_part(n, ' ', 1) = f.k where n is not null",
    "segmentation_scores": """with l as (select old_seg_key t, new_seg_key f, max(intersection_m2) a, max(old_fraction) o, max(new_fraction) n from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5) group by 1, 2),
g as (select t, max(o) c, count(*) filter (where o >= 0.2) s, max(a / (a / o + a / n - a)) i, arg_max(f, (a, f)) f from l where a is not null and o > 0 and n > 0 group by 1), m as (select *, count(*) over (partition by f) m from g),
r as (select count(*) n, avg((c >= 0.5)::int) recall, avg((s >= 2)::int) split, avg((m > 1)::int) merge, median(i) iou from m)
select n, round(recall, 9) recall, round(split, 9) split, round(merge, 9) as merge, round(iou, 9) iou, round(3 / (1 / recall + 1 / (1 - split) + 1 / iou), 9) objective from r""",
    "otsu_thresholds": "with h as (select growth_setting g, floor(height_max_m)::bigint b, count(*) k from tree_assets_pilot where height_max_m is not null group by 1, 2), t as (select g, b, sum(k) over u n0, sum(b * k) over u s0, sum(k) over (partition by g) n, sum(b * k) over (partition by g) s from h window u as (partition by g order by b rows unbounded preceding)), v as (select *, coalesce(n0 * nullif(n - n0, 0) * pow(s0 / n0 - (s - s0) / nullif(n - n0, 0), 2), -1) v from t) select g growth_setting, n::bigint n, (b + 1)::double threshold from v qualify row_number() over (partition by g order by v desc, b) = 1",
    "smoothed_cells": f"with {XY_SQL}, {HT}, {CELLS}, {_OFF}, w as (select i + a i, j + b j, avg(h) h from cell, o group by 1, 2) select i, j, round(w.h, 6) h from w join cell using (i, j)",
    "despiked_cells": f"with {XY_SQL}, {HT}, {CELLS}, {_OFF}, w as (select i + a i, j + b j, median(h) m from cell, o group by 1, 2) select i, j, round(case when h - m > 5 then m else h end, 6) h from w join cell using (i, j)",
    "saddles": f"with {XY_SQL}, {HT}, {CELLS}, p as (select a.tree_id a_id, b.tree_id b_id, a.x xa, a.y ya, b.x xb, b.y yb, least(a.h, b.h) low from ht a join ht b on a.tree_id < b.tree_id and a.h > 10 and b.h > 10 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 12), q as (select a_id, b_id, low, floor((xa + (xb - xa) * k / 10) / 10)::bigint i, floor((ya + (yb - ya) * k / 10) / 10)::bigint j from p, (select unnest(range(0, 11)) k)), r as (select a_id, b_id, min(coalesce(h, 0)) / any_value(low) s from q left join cell using (i, j) group by 1, 2) select a_id, b_id, round(s, 6) saddle, s >= 0.7 one_crown from r",
    "merge_clusters": f"""with recursive {XY_SQL}, {HT}, chm as (select floor(x / 3)::bigint i, floor(y / 3)::bigint j, max(h) h from ht group by 1, 2),
n as (select a.tree_id u, b.tree_id v, a.x x0, a.y y0, b.x - a.x dx, b.y - a.y dy from ht a join ht b on a.tree_id < b.tree_id and abs(a.x - b.x) <= 6 and abs(a.y - b.y) <= 6 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 6),
s as (select u, v, list(coalesce(h, 0) order by k) hs from (select n.*, k from n, range(6) r(k)) left join chm on i = floor((x0 + dx * k / 5) / 3)::bigint and j = floor((y0 + dy * k / 5) / 3)::bigint group by u, v),
ok as (select u, v from s where least(hs[1], hs[6]) >= 3 and list_min(hs[2:5]) >= 0.6 * least(hs[1], hs[6])),
e as (select u, v from ok union select v, u from ok), r(u, v) as (select u, u from e union select r.u, e.v from r join e on r.v = e.u), k as (select u id, min(v) m from r group by 1),
f as (select k.*, case src when 'tree_register' then 0 else 1 end rk, coalesce(h0, 0) ar from k join ht on id = tree_id)
select id, m as cluster, count(*) over (partition by m) as size, case when count(*) over (partition by m) <= 5 then 'auto' else 'review_large' end merge_class, row_number() over (partition by m order by rk, ar desc, id) = 1 is_primary from f""",
    "candidate_audit": f"with {XY_SQL}, n as (select a.tree_id t, b.tree_id k from xy a join xy b on not starts_with(a.src, 'lidar') and starts_with(b.src, 'lidar') and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 6), m as (select distinct nullif(lower(trim(primary_tree_id, ' ' || chr(9))), '') t, nullif(lower(trim(member_tree_id, ' ' || chr(9))), '') k from tree_crown_merge_pilot), l as (select * from m where t is not null and k is not null and t <> k) select concat_ws('+', case when n.t is not null then 'near' end, case when l.t is not null then 'linked' end) basis, count(*) n from n full join l on n.t = l.t and n.k = l.k group by 1",
    "context_join": f"""with {PIP}, {SUPP}, r as (select p_id k, min(region_id) region_id from hit group by 1),
n as (select c.k, s.k facility, round(sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)), 6) facility_m from cust c, supp s where sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)) <= 100 qualify row_number() over (partition by c.k order by sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2)), s.k) = 1),
l as (select k, x x1, y y1, (k % 5 - 2) * 90.0 dx, (k % 7 - 3) * 80.0 dy from supp), w as (select c.k, l.k % 3 = 0 flow, c.x - x1 px, c.y - y1 py, dx, dy, case when dx * dx + dy * dy = 0 then 0 else least(1, greatest(0, ((c.x - x1) * dx + (c.y - y1) * dy) / (dx * dx + dy * dy))) end u from cust c join l on abs(c.x - x1) <= 230 and abs(c.y - y1) <= 290),
b as (select k, bool_or(not flow) road, bool_or(flow) flow from w where sqrt(pow(px - u * dx, 2) + pow(py - u * dy, 2)) <= 40 group by 1),
g as (select floor(x / 200)::bigint i, floor(y / 200)::bigint j, max(v) t from cust group by 1, 2 having (floor(x / 200)::bigint + floor(y / 200)::bigint) % 3 <> 0),
q as (select c.k, arg_min(g.t, (case when g.i = floor(c.x / 200) and g.j = floor(c.y / 200) then -1 else sqrt(pow((g.i + 0.5) * 200 - c.x, 2) + pow((g.j + 0.5) * 200 - c.y, 2)) end, g.i || '_' || g.j)) t from cust c join g on abs(g.i - floor(c.x / 200)) <= 2 and abs(g.j - floor(c.y / 200)) <= 2 and sqrt(pow((g.i + 0.5) * 200 - c.x, 2) + pow((g.j + 0.5) * 200 - c.y, 2)) <= 300 group by 1)
select cust.k, region_id, facility, facility_m, coalesce(road, false) road_40m, coalesce(flow, false) flow_path_40m, t temperature from cust left join r using (k) left join n using (k) left join b using (k) left join q using (k)""",
    "impervious_fraction": f"with {CUST}, {SUPP}, o as (select c.k, (least(c.x + 15, s.x + 50 + s.k % 60) - greatest(c.x - 15, s.x)) * (least(c.y + 15, s.y + 40 + s.k % 90) - greatest(c.y - 15, s.y)) a from cust c, supp s where least(c.x + 15, s.x + 50 + s.k % 60) > greatest(c.x - 15, s.x) and least(c.y + 15, s.y + 40 + s.k % 90) > greatest(c.y - 15, s.y)), g as (select k, round(least(sum(a / 900), 1), 6)::double sealed from o group by 1) select cust.k, coalesce(sealed, 0) sealed from cust left join g using (k)",
    "identity_build": f"with l as (select distinct new_seg_key k, {ID.replace('tree_id', 'old_tree_id')} t, coalesce(intersection_m2, 0) a from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5)), o as (select t, max(k) k, max(a) a from l where t is not null group by t having count(distinct k) = 1), p as (select k, arg_max(t, (a, t)) t from o group by 1) select distinct l.k new_seg_key, coalesce(p.t, 'tree_' || substr(sha256(l.k), 1, 20)) tree_id, p.t is null is_new from l left join p on l.k = p.k",
    "current_state": f"with t as (select {ID} k, max(retired_at) g, min(record_role) r from trees group by 1) select case when g is not null then 'earlier_detection' when r = 'remote_sensing_detection' then 'detection' else 'record' end display_role, count(*) n from t group by 1",
    "adjusted_priors": f"with p as (select {ID} tree_id, coalesce(try_cast(model_confidence as double), 0.5) p from tree_root_zone_pilot where model_confidence is not null) select distinct tree_id, round(p * 0.4 / nullif(p * 0.4 + (1 - p) * 1.6, 0), 9) p from p",
    "rooftop_anti_join": f"with {CUST}, {SUPP} select c.k p_id from cust c where not exists (select 1 from supp s where c.x >= s.x and c.x < s.x + 40 and c.y >= s.y and c.y < s.y + 40)",
}
