"""Queries of point-cloud, height-cell, trajectory and linking operators, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import growth
from grovekit.operators import spatial as sp
from grovekit.operators import survey as op
from grovekit.operators.proximity import near_points
from grovekit.plans.spatial import ID, XY, XY_SQL, points
from grovekit.session import current, plain_id, table

c = F.col


def _returns(s, d):
    return table(s, d, "lineitem").select(c("l_suppkey").alias("k"), c("l_quantity").alias("z"), "l_returnflag", "l_linestatus", "l_linenumber", (c("l_partkey") % 40).alias("px"), (c("l_orderkey") % 40).alias("py"))


def pointcloud_verdict(s: SparkSession, d: str) -> DataFrame:
    r = op.return_summary(_returns(s, d), "k", "z", c("l_returnflag") == "A", (c("l_returnflag") == "R") & (c("l_linestatus") == "O"), c("l_linenumber") == 1, c("l_linenumber") > 3)
    return r.select("k", "n", "n_veg", "n_building", *[F.round(x, 6).alias(x) for x in ("multi_share", "cover", "top", "base", "mean", "spread", "relief")], "verdict")


def foliage_histogram(s, d):
    return op.foliage_profile(_returns(s, d), "k", "z")


def rugosity(s, d):
    r = op.rugosity(_returns(s, d), "k", c("px"), c("py"), "z")
    return r.select("k", "n_pixels", F.round("rugosity", 6).alias("rugosity"))


def _heights(s, d):
    a = table(s, d, "tree_assets_pilot").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.max("height_max_m").alias("h"), F.min("height_max_m").alias("h0"))
    return points(s, d).join(a, "tree_id").where("h is not null")


HT = f"a as (select {ID} tree_id, max(height_max_m) h, min(height_max_m) h0 from tree_assets_pilot group by 1), ht as (select xy.*, h, h0 from xy join a using (tree_id) where h is not null)"
CELLS = "cell as (select floor(x / 10)::bigint i, floor(y / 10)::bigint j, max(h) h from ht group by 1, 2)"


def _cells(s, d, size=10.0):
    return op.cell_max(_heights(s, d), "x", "y", "h", size)


def cell_maxima(s, d):
    return _cells(s, d)


def closed_cells(s, d):
    return op.closing(_cells(s, d))


def cell_peaks(s, d):
    return op.local_peaks(_cells(s, d), 2, 3.0)


def crown_segments(s, d):
    return op.segment_crowns(_cells(s, d))


def seed_crowns(s, d):
    seeds = _heights(s, d).where("h > 12").select(c("tree_id").alias("seed"), "x", "y", "h")
    a = op.seed_allocation(_cells(s, d), seeds, 10.0, F.least(F.greatest(c("h") * 0.65, F.lit(5.0)), F.lit(14.0)), 14.0)
    return a


def _height_crowns(s, d):
    seeds = _heights(s, d).where("h > 12").select(c("tree_id").alias("seed"), "x", "y", "h")
    return op.height_crowns(_cells(s, d, 4.0), seeds, 4.0)


def height_limited_crowns(s, d):
    return _height_crowns(s, d).groupBy("seed").agg(F.count("*").alias("n_cells"), F.round(F.sum("h"), 6).alias("sum_h"))


def trimmed_crowns(s, d):
    """Cells of each growth setting's crown heights that each way of trimming leaves."""
    a = table(s, d, "tree_assets_pilot").where("height_max_m is not null and growth_setting is not null").select(c("growth_setting").alias("k"), c("height_max_m").alias("h"))
    t = op.trim_heights(a, "k")
    n = [F.count(F.when(c("h") >= c(f"by_{w}"), 1)).alias(f"n_{w}") for w in ("share", "drop", "quantile", "otsu")]
    return a.join(t, "k").groupBy("k").agg(*n)


def missed_trees(s, d):
    known = points(s, d).where("src not like 'lidar%'")
    return op.missed_trees(_cells(s, d), 10.0, known, XY, 8.0)


def trusted_links(s, d):
    """Links of the last snapshot on crowns with one recorded genus at most."""
    l = current(table(s, d, "tree_crown_lineage_v5")).select("new_seg_key", plain_id("old_tree_id").alias("tree_id")).where("tree_id is not null").distinct()
    g = table(s, d, "trees").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.min(F.lower(F.split(F.btrim("species_latin"), " ")[0])).alias("genus"))
    return op.trusted_links(l.join(g, "tree_id", "left"), "new_seg_key", "genus").select("new_seg_key", "tree_id", "genus", "n_on_crown")


def crown_segments_mean(s, d):
    return op.segment_crowns(_cells(s, d, 2.0), way="mean")


def crown_segments_spacing(s, d):
    return op.segment_crowns(_cells(s, d, 2.0), way="spacing", share=0.1)


def record_crowns(s, d):
    p = points(s, d).where("src not like 'lidar%'")
    return op.record_crowns(_cells(s, d, 4.0), _height_crowns(s, d), p, XY, 4.0, 8.0)


def tall_patches(s, d):
    p = op.patches(_cells(s, d).where("h >= 10"), True, 3)
    return p.groupBy("patch").agg(F.count("*").alias("n")).select(c("patch.i").alias("i"), c("patch.j").alias("j"), "n")


def strip_shapes(s, d):
    g = op.shape(points(s, d).withColumn("gx", F.floor(c("x") / 150)).withColumn("gy", F.floor(c("y") / 150)), ["gx", "gy"], "x", "y")
    return g.where("n >= 5").select("gx", "gy", "n", *[F.round(x, 6).alias(x) for x in ("length", "width", "elongation", "fill")])


def zonal_stats(s, d):
    z = op.zonal(_heights(s, d).withColumn("zone", F.concat_ws("_", F.floor(c("x") / 300), F.floor(c("y") / 300))), "zone", "h", 100.0)
    return z.select("zone", "n", *[F.round(x, 6).alias(x) for x in ("p25", "p50", "p75", "p95", "max", "mean", "std", "volume", "vertical_ratio")])


def growth_classes(s, d):
    z = op.zonal_change(_heights(s, d).withColumn("zone", F.concat_ws("_", F.floor(c("x") / 300), F.floor(c("y") / 300))), "zone", "h0", "h", 8.0)
    return z.select("zone", "n", F.round("change", 6).alias("change"), F.round("rate", 6).alias("rate"), F.round("cover_change", 9).alias("cover_change"), "state")


def sampled_heights(s, d):
    return op.sample_max(points(s, d), XY, _cells(s, d), 10.0, 12.0)


def disc_evidence(s, d):
    return op.disc_evidence(points(s, d), XY, _cells(s, d), 10.0, [8.0, 15.0])


def canopy_cover_by_zone(s, d):
    t = table(s, d, "tree_low_canopy_candidates").where("x_2193 is not null").withColumn("zone", F.concat_ws("_", F.floor(c("x_2193") / 500), F.floor(c("y_2193") / 500)))
    r = op.canopy_cover(t, "zone", "height_m", "gli", 2.0, 0.05)
    return r.select("zone", "n", F.round("cover", 9).alias("cover"), F.round("coverage", 9).alias("coverage"), "lower_bound")


def low_canopy_scores(s, d):
    t = table(s, d, "tree_low_canopy_candidates").where("height_m is not null and gli is not null")
    v = op.low_canopy_score(c("height_m"), c("gli"))
    return t.select("candidate_id", F.round(v, 9).alias("score"), (v >= 0.6).alias("promoted")).distinct()


def promoted_candidates(s, d):
    """Candidates with a score of 0.6 not marked as excluded, no tree within 3 m and no better candidate within 3 m (of
    equal ones the smaller id stays), with their circular crown."""
    t = table(s, d, "tree_low_canopy_candidates").where("x_2193 is not null and y_2193 is not null and coalesce(valuation_excluded, 0) = 0")
    t = t.groupBy("candidate_id").agg(*[F.min(x).alias(x) for x in ("lon", "lat", "x_2193", "y_2193")], F.max("confidence_score").alias("score"), F.max("height_m").alias("h")).where("score >= 0.6")
    near = near_points(t, c("candidate_id"), table(s, d, "trees"), plain_id("tree_id"), 3.0).select(c("centre_id").alias("candidate_id")).distinct()
    free = t.join(near, "candidate_id", "left_anti")
    worse = sp.near_pairs(free, ("candidate_id", "x_2193", "y_2193"), 3.0, ("score",)).select(F.when(c("a_score") >= c("b_score"), c("b_id")).otherwise(c("a_id")).alias("candidate_id")).distinct()
    r = growth.crown_radius(c("h"))
    return free.join(worse, "candidate_id", "left_anti").select("candidate_id", F.round("score", 9).alias("score"), F.round(r, 6).alias("crown_radius_m"), F.round(r * r * math.pi, 6).alias("crown_area_m2"))


def tile_halo_counts(s, d):
    h = op.with_halo(points(s, d), "x", "y", 250.0, 15.0)
    return h.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.sum(c("owner").cast("int")).alias("n_owned"))


def hedge_points(s, d):
    """Strips densified to a point every 5 m, each with the nearest tree within 6 m."""
    k = c("s_suppkey")
    l = table(s, d, "supplier").select(k.alias("k"), ((k * 7919) % 1200 * 1.0).alias("x"), ((k * 104729) % 1400 * 1.0).alias("y"))
    p = l.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).select(F.concat_ws("_", "k", "i").alias("pid"), (c("x") + c("i") * 5.0).alias("x"), "y")
    n = sp.nearest_within(p, points(s, d), ("pid", "x", "y"), XY, 6.0)
    return n.select(c("a_id").alias("pid"), F.round("d", 6).alias("d"))


def _epochs(s, d):
    l = table(s, d, "lineitem")
    g = l.groupBy("l_orderkey").agg(*[F.max(F.when((c("l_linenumber") - 1) % 3 == i - 1, c("l_quantity") / f)).alias(n) for i, n, f in ((1, "h13", 4), (2, "h16", 3), (3, "h24", 2))], F.max(F.abs("l_discount")).alias("gli"))
    return g.withColumn("p24", F.coalesce(c("h24") >= 8, F.lit(False)))


def trajectory_fates(s, d):
    e = _epochs(s, d)
    return e.select("l_orderkey", op.fate(c("p24"), c("h13"), c("h16"), c("h24"), c("gli")).alias("fate"))


def removal_confidence(s, d):
    e = _epochs(s, d)
    v = op.removal_confidence(c("h13").isNotNull(), c("h16").isNotNull(), c("h16"), F.coalesce(c("h16") - c("h13") > 4, F.lit(False)))
    return e.groupBy(v.alias("confidence")).agg(F.count("*").alias("n"))


def height_forecast(s, d):
    e = _epochs(s, d).where("h24 is not null")
    own = (c("h24") - c("h16")) / 8
    e = e.withColumn("own", own).withColumn("band", F.floor(c("h24") / 5))
    q = e.where("own is not null").groupBy("band").agg(F.percentile("own", 0.5).alias("cohort"))
    j = e.join(q, "band")
    return j.select("l_orderkey", F.round(op.height_forecast(c("h24"), c("cohort"), c("own"), 6.0), 6).alias("h2030"), F.round(op.height_forecast(c("h24"), c("cohort"), c("own"), 16.0), 6).alias("h2040"))


def stitched_surveys(s, d):
    h = _heights(s, d)
    b = h.select(F.concat(F.lit("n"), "tree_id").alias("id"), (c("x") + 0.5).alias("x"), (c("y") - 0.5).alias("y"), (c("h") + 1.0).alias("h"))
    r = op.stitch(h.select(c("tree_id").alias("id"), "x", "y", "h"), b, 8.0, 3.0)
    return r.select("l", "r", F.round("cost", 6).alias("cost"), "exact")


def row_runs(s, d):
    t = table(s, d, "trees").where("approx_x_m is not null and source_object_id is not null").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.min("approx_x_m").alias("x"), F.min("approx_y_m").alias("y"), F.min("source_primary").alias("src"), F.min("source_object_id").alias("seq"))
    return op.runs_of(t, "src", "seq", "x", "y", "tree_id", gap=400, link=200.0).select("id", "run")


def aligned_runs(s, d):
    t = table(s, d, "trees").where("approx_x_m is not null and source_object_id is not null").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.min("approx_x_m").alias("x"), F.min("approx_y_m").alias("y"), F.min("source_primary").alias("src"), F.min("source_object_id").alias("seq"))
    m = op.runs_of(t, "src", "seq", "x", "y", "tree_id", gap=400, link=200.0)
    lidar = points(s, d).where("src like 'lidar%'")
    return op.align_runs(m, lidar, XY, 8.0).select("run", "n", *[F.round(x, 6).alias(x) for x in ("dx", "dy", "before", "after")])


def offset_evidence(s, d):
    """Monotone evidence per distance bin of records against detected crowns, decoys at seeded places."""
    p = points(s, d)
    rec, top = p.where("src not like 'lidar%'"), p.where("src like 'lidar%'")
    v = op.displaced(c("x"), c("y"), c("tree_id"), 25.0, 45.0)
    dec = rec.select("tree_id", v["x"].alias("x"), v["y"].alias("y"))
    bins = lambda f: {r["b"]: r["count"] for r in sp.near_join(f, top, XY, XY, 10.0).groupBy(F.floor("d").alias("b")).count().collect()}  # noqa: E731  ten rows
    a, b, n = bins(rec), bins(dec), rec.count()
    llr, share = op.offset_evidence(np.array([a.get(i, 0) for i in range(10)], float), np.array([b.get(i, 0) / max(n, 1) for i in range(10)]), n)
    return s.createDataFrame([(i, int(a.get(i, 0)), float(llr[i]), float(share)) for i in range(10)], "bin int, n long, llr double, share double")


def choice_weights(s, d):
    """Weights of a choice model: which old crown a new one continues, from shares and area."""
    l = current(table(s, d, "tree_crown_lineage_v5")).where("intersection_m2 is not null and old_fraction is not null and new_fraction is not null")
    l = l.groupBy("new_seg_key", "old_seg_key").agg(F.max("intersection_m2").alias("a"), F.max("old_fraction").alias("o"), F.max("new_fraction").alias("n"))
    top = l.groupBy("new_seg_key").agg(F.max(F.struct("a", "old_seg_key"))["old_seg_key"].alias("best"))
    x = l.join(top, "new_seg_key").withColumn("y", (c("old_seg_key") == c("best")).cast("double"))
    w = op.conditional_logit(x, "new_seg_key", "y", ["o", "n"], ridge=1.0)
    return s.createDataFrame([("old_fraction", float(w[0])), ("new_fraction", float(w[1]))], "feature string, weight double")


def holdout_scores(s, d):
    """Precision and recall of the 3 m rule for finding the same tree again, per fold of the ids."""
    p = points(s, d)
    v = op.displaced(c("x"), c("y"), c("tree_id"), 0.0, 4.0)
    q = p.select("tree_id", v["x"].alias("x"), v["y"].alias("y"))
    n = sp.nearest_within(q, p, XY, XY, 3.0)
    j = p.select("tree_id", op.fold_of(c("tree_id")).alias("fold")).join(n.select(c("a_id").alias("tree_id"), "b_id"), "tree_id", "left")
    g = j.groupBy("fold").agg(F.count("*").alias("n"), F.count("b_id").alias("n_linked"), F.sum(F.coalesce((c("b_id") == c("tree_id")).cast("int"), F.lit(0))).alias("n_right"))
    return g.select("fold", "n", F.round(c("n_right") / c("n_linked"), 9).alias("precision"), F.round(c("n_right") / c("n"), 9).alias("recall"))


def crown_radius_check(s, d):
    """Detected crowns against drawn ones: size within its genus' usual range."""
    r = table(s, d, "tree_root_zone_pilot").where("crown_radius_m is not null and dbh_cm is not null")
    return r.select(plain_id("tree_id").alias("tree_id"), F.round(growth.size_llr(c("crown_radius_m"), F.lit(4.0), F.lit(1.5)), 6).alias("llr")).distinct()


QUERIES = {f.__name__: f for f in (
    pointcloud_verdict, foliage_histogram, rugosity, cell_maxima, closed_cells, cell_peaks, crown_segments, seed_crowns, tall_patches, strip_shapes, zonal_stats, growth_classes,
    sampled_heights, disc_evidence, canopy_cover_by_zone, low_canopy_scores, promoted_candidates, tile_halo_counts, hedge_points, trajectory_fates, removal_confidence,
    height_forecast, stitched_surveys, row_runs, aligned_runs, offset_evidence, choice_weights, holdout_scores, crown_radius_check,
    height_limited_crowns, trimmed_crowns, missed_trees, trusted_links, crown_segments_mean, crown_segments_spacing, record_crowns,
)}

_EP = "ep as (select l_orderkey, max(l_quantity / 4) filter (where (l_linenumber - 1) % 3 = 0) h13, max(l_quantity / 3) filter (where (l_linenumber - 1) % 3 = 1) h16, max(l_quantity / 2) filter (where (l_linenumber - 1) % 3 = 2) h24, max(abs(l_discount)) gli from lineitem group by 1)"
_SC = "0.6 * least(greatest((height_m - 1.0) / 4.0, 0), 1) + 0.4 * least(greatest(gli / 0.2, 0), 1)"
SQL = {
    "pointcloud_verdict": """with r as (select l_suppkey k, l_quantity z, l_returnflag = 'A' v, l_returnflag = 'R' and l_linestatus = 'O' b, l_linenumber = 1 f, l_linenumber > 3 m from lineitem),
g as (select k, count(*) n, count(*) filter (where v) nv, count(*) filter (where b) nb, count(*) filter (where m) nm, count(*) filter (where f) nf, count(*) filter (where f and v) nfv, min(z) g0, min(z) filter (where v) v0, max(z) filter (where v) v1, avg(z) filter (where v) va, stddev_pop(z) filter (where v) vs from r group by 1)
select k, n, nv n_veg, nb n_building, round(nm / n, 6) multi_share, round(nfv / nullif(nf, 0), 6) cover, round(v1 - g0, 6) top, round(v0 - g0, 6) base, round(va - g0, 6) mean, round(vs, 6) spread, round((va - v0) / nullif(v1 - v0, 0), 6) relief,
 case when n < 30 then 'sparse' when nv + nb = 0 then 'mixed' when nv / (nv + nb) >= 0.7 then case when coalesce(v1 - g0 >= 2 and nv >= 8 and nv / n >= 0.25, false) then 'vegetation' else 'low_vegetation' end when nv / (nv + nb) <= 0.3 then case when nb >= nv then 'building' else 'structure' end else 'mixed' end verdict from g""",
    "rugosity": "with p as (select l_suppkey k, l_partkey % 40 px, l_orderkey % 40 py, max(l_quantity) t from lineitem group by 1, 2, 3) select k, count(*) n_pixels, round(case when count(*) >= 4 then stddev_pop(t) end, 6) rugosity from p group by 1",
    "cell_maxima": f"with {XY_SQL}, {HT}, {CELLS} select * from cell",
    "closed_cells": f"with {XY_SQL}, {HT}, {CELLS}, o as (select a::bigint a, b::bigint b from (select unnest([-1, 0, 1]) a), (select unnest([-1, 0, 1]) b)), w as (select i + a i, j + b j, max(h) h from cell, o group by 1, 2), n as (select i + a i, j + b j, min(h) h from w, o group by 1, 2) select n.* from n join cell using (i, j)",
    "cell_peaks": f"with {XY_SQL}, {HT}, {CELLS} select i, j, h from cell a where h >= 3 and not exists (select 1 from cell b where abs(a.i - b.i) <= 2 and abs(a.j - b.j) <= 2 and (b.h > a.h or (b.h = a.h and (b.i < a.i or (b.i = a.i and b.j < a.j)))))",
    "height_limited_crowns": f"""with {XY_SQL}, {HT}, c4 as (select floor(x / 4)::bigint i, floor(y / 4)::bigint j, max(h) h from ht group by 1, 2),
q as (select i, j, c4.h, tree_id seed, ht.h top, sqrt(((i + 0.5) * 4 - x) * ((i + 0.5) * 4 - x) + ((j + 0.5) * 4 - y) * ((j + 0.5) * 4 - y)) d from c4 join ht on ht.h > 12 and abs(i - floor(x / 4)) <= 4 and abs(j - floor(y / 4)) <= 4),
n as (select * from q where d <= 14 qualify row_number() over (partition by i, j order by d, seed) = 1) select seed, count(*) n_cells, round(sum(h), 6) sum_h from n where d <= 0.6 * top and h >= 0.3 * top group by 1""",
    "trimmed_crowns": """with a as (select growth_setting k, height_max_m h from tree_assets_pilot where height_max_m is not null and growth_setting is not null),
g as (select k, count(*) n, max(h) top, min(h) low, quantile_cont(h, 0.25) q from a group by 1),
b as (select k, least(floor((h - low) / ((top - low) / 32)), 31) b, count(*) w from a join g using (k) where n >= 8 and top - low >= 1e-6 group by 1, 2),
m as (select k, low + (b + 0.5) * ((top - low) / 32) mid, sum(w) over r w0, sum(w * (low + (b + 0.5) * ((top - low) / 32))) over r m0, sum(w * (low + (b + 0.5) * ((top - low) / 32))) over (partition by k) m, n from b join g using (k) window r as (partition by k order by b)),
o as (select k, mid from m qualify row_number() over (partition by k order by w0 * (n - w0) * pow(m0 / w0 - (m - m0) / greatest(n - w0, 1), 2) desc, mid) = 1)
select a.k, count(*) filter (where h >= top * 0.5) n_share, count(*) filter (where h >= top - 5) n_drop, count(*) filter (where h >= q) n_quantile, count(*) filter (where h >= coalesce(mid, top * 0.5)) n_otsu from a join g using (k) left join o using (k) group by 1""",
    "missed_trees": f"with {XY_SQL}, {HT}, {CELLS}, p as (select i, j, h from cell a where h >= 3 and not exists (select 1 from cell b where abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 and (b.h > a.h or (b.h = a.h and (b.i < a.i or (b.i = a.i and b.j < a.j)))))) select i, j, h, case when h >= 8 then 'high' else 'low' end tier from p where not exists (select 1 from xy where not starts_with(src, 'lidar') and sqrt(((i + 0.5) * 10 - x) * ((i + 0.5) * 10 - x) + ((j + 0.5) * 10 - y) * ((j + 0.5) * 10 - y)) <= 8)",
    "trusted_links": f"with l as (select distinct new_seg_key, {ID.replace('tree_id', 'old_tree_id')} t from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5)), g as (select {ID} t, min(lower(split_part(trim(species_latin), ' ', 1))) genus from trees group by 1), j as (select l.new_seg_key, l.t, genus from l left join g on l.t = g.t where l.t is not null) select new_seg_key, t tree_id, genus, count(*) over (partition by new_seg_key) n_on_crown from j qualify count(distinct genus) over (partition by new_seg_key) <= 1",
    "seed_crowns": f"with {XY_SQL}, {HT}, {CELLS}, q as (select i, j, tree_id seed, sqrt(((i + 0.5) * 10 - x) * ((i + 0.5) * 10 - x) + ((j + 0.5) * 10 - y) * ((j + 0.5) * 10 - y)) d, least(greatest(0.65 * ht.h, 5), 14) r from cell, ht where ht.h > 12) select i, j, seed from q where d <= r qualify row_number() over (partition by i, j order by d, seed) = 1",
    "tall_patches": f"with recursive {XY_SQL}, {HT}, {CELLS}, t as (select i * 100000 + j k, i, j from cell where h >= 10), e as (select a.k u, b.k v from t a join t b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1), r(u, v) as (select k, k from t union select r.u, e.v from r join e on r.v = e.u), p as (select u, min(v) m from r group by 1) select m // 100000 i, m % 100000 j, count(*) n from p group by m having count(*) >= 3",
    "strip_shapes": f"with {XY_SQL}, g as (select floor(x / 150)::bigint gx, floor(y / 150)::bigint gy, count(*) n, var_pop(x) a, var_pop(y) b, covar_pop(x, y) k, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) bx from xy group by 1, 2), m as (select *, (a + b) / 2 mid, sqrt(pow(a - b, 2) / 4 + k * k) rt from g where n >= 5) select gx, gy, n, round(4 * sqrt(mid + rt), 6) length, round(4 * sqrt(greatest(mid - rt, 0)), 6) width, round(sqrt((mid + rt) / greatest(mid - rt, 1e-6)), 6) elongation, round(n / bx, 6) fill from m",
    "zonal_stats": f"with {XY_SQL}, {HT}, z as (select floor(x / 300)::bigint || '_' || floor(y / 300)::bigint zone, h from ht) select zone, count(*) n, round(quantile_cont(h, 0.25), 6) p25, round(quantile_cont(h, 0.5), 6) p50, round(quantile_cont(h, 0.75), 6) p75, round(quantile_cont(h, 0.95), 6) p95, round(max(h), 6) as max, round(avg(h), 6) mean, round(stddev_pop(h), 6) std, round(sum(h) * 100, 6) volume, round(avg(h) / nullif(max(h), 0), 6) vertical_ratio from z group by 1",
    "growth_classes": f"with {XY_SQL}, {HT}, z as (select floor(x / 300)::bigint || '_' || floor(y / 300)::bigint zone, h0, h from ht), g as (select zone, count(*) n, max(h) - max(h0) ch, avg((h >= 3)::int) - avg((h0 >= 3)::int) cc, sum((h0 >= 3)::int) n0 from z group by 1) select zone, n, round(ch, 6) change, round(ch / 8, 6) rate, round(cc, 9) cover_change, case when n0 < 3 then 'too_little_canopy' when cc <= -0.5 then 'lost' when ch / 8 > 0.1 then 'growing' when ch / 8 < -0.1 then 'declining' else 'stable' end state from g",
    "sampled_heights": f"with {XY_SQL}, {HT}, {CELLS} select tree_id p_id, (select max(h) from cell where sqrt(((i + 0.5) * 10 - x) * ((i + 0.5) * 10 - x) + ((j + 0.5) * 10 - y) * ((j + 0.5) * 10 - y)) <= 12) h from xy",
    "disc_evidence": f"with {XY_SQL}, {HT}, {CELLS}, q as (select tree_id p_id, cell.h, sqrt(((i + 0.5) * 10 - x) * ((i + 0.5) * 10 - x) + ((j + 0.5) * 10 - y) * ((j + 0.5) * 10 - y)) d from xy join cell on abs(i - floor(x / 10)) <= 2 and abs(j - floor(y / 10)) <= 2) select p_id, count(*) filter (where d <= 8) n_8_0, count(*) filter (where d <= 8 and h >= 3) tall_8_0, max(h) filter (where d <= 8) max_8_0, count(*) n_15_0, count(*) filter (where h >= 3) tall_15_0, max(h) max_15_0 from q where d <= 15 group by 1",
    "canopy_cover_by_zone": "with t as (select floor(x_2193 / 500)::bigint || '_' || floor(y_2193 / 500)::bigint zone, height_m h, gli g from tree_low_canopy_candidates where x_2193 is not null), k as (select zone, count(*) n, count(*) filter (where h is not null and g is not null) o, count(*) filter (where h >= 2 and g >= 0.05) k from t group by 1) select zone, n, round(k / nullif(o, 0), 9) cover, round(o / n, 9) coverage, o / n < 0.8 lower_bound from k",
    "low_canopy_scores": f"select distinct candidate_id, round({_SC}, 9) score, {_SC} >= 0.6 promoted from tree_low_canopy_candidates where height_m is not null and gli is not null",
    "tile_halo_counts": f"with {XY_SQL}, b as (select *, unnest(range(floor((x - 15) / 250)::bigint, floor((x + 15) / 250)::bigint + 1)) tx from xy), q as (select *, unnest(range(floor((y - 15) / 250)::bigint, floor((y + 15) / 250)::bigint + 1)) ty from b) select tx, ty, count(*) n, count(*) filter (where tx = floor(x / 250) and ty = floor(y / 250)) n_owned from q group by 1, 2",
    "hedge_points": f"with {XY_SQL}, p as (select s_suppkey || '_' || i pid, (s_suppkey * 7919) % 1200 + i * 5.0 px, ((s_suppkey * 104729) % 1400)::double py from supplier, (select unnest(range(0, 11)) i)), q as (select pid, sqrt((px - x) * (px - x) + (py - y) * (py - y)) d from p, xy) select pid, round(min(d), 6) d from q where d <= 6 group by 1",
    "trajectory_fates": f"with {_EP}, f as (select *, coalesce(h24 >= 8, false) p, coalesce(h13 >= 5, false) c13, coalesce(h16 >= 5, false) c16, coalesce(h24 >= 5, false) c24, coalesce(h13 < 2, false) g13, coalesce(h16 < 2, false) g16, coalesce(h24 < 2, false) g24 from ep) select l_orderkey, case when p and g13 and not c16 then 'established_since_2013' when p and g16 then 'established_since_2016' when p and (c13 or c16) then 'persistent' when p and h13 is null and h16 is null then 'outside_historic_coverage' when not p and g24 and (c13 or c16) then 'removed_to_open' when not p and c24 and gli < 0.05 and (c13 or c16) then 'candidate_conversion' when not p and c24 and (c13 or c16) then 'persistent' else 'indeterminate' end fate from f",
    "removal_confidence": f"with {_EP}, f as (select (h13 is not null)::int + (h16 is not null)::int + case when h16 >= 12 then 2 when h16 >= 8 then 1 else 0 end + case when coalesce(h16 - h13 > 4, false) then 0 else 1 end s from ep) select case when s >= 4 then 'high' when s >= 2 then 'medium' else 'low' end confidence, count(*) n from f group by 1",
    "height_forecast": f"with {_EP}, e as (select *, (h24 - h16) / 8 own, floor(h24 / 5) band from ep where h24 is not null), q as (select band, quantile_cont(own, 0.5) k from e where own is not null group by 1), j as (select *, case when own is null then k else k * 0.5 + own * 0.5 end r from e join q using (band)) select l_orderkey, round(greatest(h24 + r * 6, 0), 6) h2030, round(greatest(h24 + r * 16, 0), 6) h2040 from j",
    "crown_radius_check": f"select distinct {ID} tree_id, round(greatest(least(-pow((crown_radius_m - 4.0) / 1.5, 2) / 2 - ln(1.5 * sqrt(2 * pi())) - ln(0.05), 3.0), -6.0), 6) llr from tree_root_zone_pilot where crown_radius_m is not null and dbh_cm is not null",
    "promoted_candidates": f"""with t as (select candidate_id k, min(lon) lon, min(lat) lat, min(x_2193) x, min(y_2193) y, max(confidence_score) s, max(height_m) h from tree_low_canopy_candidates
  where x_2193 is not null and y_2193 is not null and coalesce(valuation_excluded, 0) = 0 group by 1 having max(confidence_score) >= 0.6),
g as (select distinct lon, lat from trees where tree_id is not null and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)),
n as (select distinct k from t join g on abs(t.lat - g.lat) < 0.00004 and abs(t.lon - g.lon) < 0.0002 where 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(t.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - g.lon) / 2), 2)))) <= 3),
f as (select * from t where k not in (select k from n))
select k candidate_id, round(s, 9) score, round(case when h is null then 2.0 else least(greatest(h * 0.45, 1.2), 5.0) end, 6) crown_radius_m, round(pow(case when h is null then 2.0 else least(greatest(h * 0.45, 1.2), 5.0) end, 2) * pi(), 6) crown_area_m2 from f
where not exists (select 1 from f o where o.k <> f.k and (o.s > f.s or (o.s = f.s and o.k < f.k)) and sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y)) <= 3)""",
    "row_runs": f"with t as (select {ID} id, min(approx_x_m) x, min(approx_y_m) y, min(source_primary) src, min(source_object_id) q from trees where approx_x_m is not null and source_object_id is not null group by 1), b as (select *, case when q - lag(q) over w <= 400 and sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) <= 200 then 0 else 1 end b from t window w as (partition by src order by q, id)), k as (select *, sum(b) over (partition by src order by q, id rows unbounded preceding)::bigint chain from b), p as (select *, row_number() over (partition by src, chain order by q, id) - 1 pos, count(*) over (partition by src, chain) n from k) select id, src || '_' || chain || '_' || floor(pos / ceil(n / ceil(n / 12)))::bigint run from p where n >= 3",
    "foliage_histogram": """with n as (select l_suppkey k, floor(l_quantity)::int bin, count(*) c from lineitem where l_quantity >= 0 group by 1, 2), g as (select k, sum(c)::bigint n, max(bin) top, max(c) peak from n group by 1),
b as (select k, n, top, peak, unnest(range(0, top + 1))::int bin from g), p as (select b.*, coalesce(c, 0) c from b left join n using (k, bin)),
q as (select *, coalesce(lead(c) over w, 0) nx, (c + coalesce(lead(c) over w, 0) + coalesce(lag(c) over w, 0)) / 3.0 sm from p window w as (partition by k order by bin)),
t as (select *, case when sm >= 0.25 * max(sm) over (partition by k) then 1 when sm < 0.1 * max(sm) over (partition by k) then 0 end st from q),
u as (select *, last_value(st ignore nulls) over (partition by k order by bin rows between unbounded preceding and 1 preceding) pr from t)
select k, n, case when n >= 8 then list(c order by bin) end profile, case when n >= 8 then (min(bin) filter (bin >= 2 and bin < top and c >= 0.25 * peak and nx >= 0.25 * peak))::double end crown_base, case when n >= 8 then greatest(count(*) filter (st = 1 and coalesce(pr, 0) <> 1), 1)::int end layers from u group by k, n""",
}
