"""Queries of joins, aggregates, rankings and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovekit.operators import relational as op
from grovekit.session import current, plain_id, table, union_all
from grovekit.sources.io import read_tiles

c = F.col
ID = "nullif(lower(trim(tree_id, ' ' || chr(9))), '')"


def _one(s, d, name, cols):
    """One row per tree id: the latest, ties by every column."""
    t = table(s, d, name).select(plain_id("tree_id").alias("tree_id"), "created_at_utc", *cols).where("tree_id is not null")
    return op.first_per_key(t, ["tree_id"], [c("created_at_utc").desc(), *[c(x).desc_nulls_last() for x in cols]])


def _one_sql(name, cols):
    order = ", ".join(["created_at_utc desc", *[f"{x} desc nulls last" for x in cols]])
    return f"(select {ID} tree_id, {', '.join(cols)} from {name} where {ID} is not null qualify row_number() over (partition by {ID} order by {order}) = 1)"


def valuation_star_join(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trees").select(plain_id("tree_id").alias("tree_id")).distinct()
    a = _one(s, d, "tree_assets_pilot", ["height_max_m"]).drop("created_at_utc")
    r = _one(s, d, "tree_root_zone_pilot", ["dbh_cm"]).drop("created_at_utc")
    g = _one(s, d, "tree_species_attributes", ["lidar_height_m"]).drop("created_at_utc")
    j = op.star_join(t, [(a, "tree_id"), (r, "tree_id"), (g, "tree_id")])
    return j.select("tree_id", F.coalesce("height_max_m", "lidar_height_m").alias("height_m"), "dbh_cm")


def inner_using(s, d):
    return table(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(table(s, d, "orders"), ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def anti_without_assets(s, d):
    t = table(s, d, "trees").select(plain_id("tree_id").alias("tree_id")).distinct()
    return t.join(table(s, d, "tree_assets_pilot").select(plain_id("tree_id").alias("tree_id")).distinct(), "tree_id", "left_anti")


def semi_in_subquery(s, d):
    o = table(s, d, "orders")
    rich = table(s, d, "customer").where("c_acctbal > 5000").select(c("c_custkey").alias("o_custkey"))
    return o.join(rich, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def not_in_with_nulls(s, d):
    keep = table(s, d, "tree_root_zone_pilot").select(plain_id("tree_id").alias("tree_id"))
    known = table(s, d, "trees").select(plain_id("tree_id").alias("tree_id"))
    return keep.where("tree_id is not null").distinct().join(known, "tree_id", "left_anti")


def duplicate_key_guard(s, d):
    return op.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def reference_fallback_lookup(s, d):
    t = table(s, d, "trees").select(plain_id("tree_id").alias("tree_id"), "species_latin").where("species_latin is not null").distinct()
    ref = table(s, d, "itree_species_ref").where("taxon_rank = 'species'")
    genus = ref.groupBy("genus").agg(F.max("mature_height_m").alias("h"))
    return op.fallback_lookup(t, [(c("species_latin"), ref, "scientific_name", "mature_height_m", "species"), (F.split("species_latin", " ")[0], genus, "genus", "h", "genus")], "mature", F.lit(12.0))


def genus_rollup(s, d):
    r = table(s, d, "itree_species_ref").where("taxon_rank = 'species'")
    n = r.groupBy("genus", "growth_form").agg(F.count("*").alias("k"), F.max("mature_height_m").alias("h"))
    return n.groupBy("genus").agg(F.min(F.struct((-c("k")).alias("k"), "growth_form"))["growth_form"].alias("modal_form"), F.max("h").alias("max_height"), F.sum("k").alias("n"))


def history_pick(s, d):
    a = table(s, d, "tree_assets_pilot")
    return a.select(plain_id("tree_id").alias("tree_id"), F.coalesce("height_p95_m", "height_p50_m").alias("h"), F.when(c("height_p95_m").isNotNull(), 8).when(c("height_p50_m").isNotNull(), 11).alias("span")).distinct()


def signature_reconcile(s, d):
    l = table(s, d, "tree_crown_lineage_v5")
    pick = lambda n: l.where(c("snapshot_no") == n).select(F.concat_ws("|", F.coalesce(plain_id("old_tree_id"), F.lit("-")), F.round("intersection_m2", 1).cast("string")).alias("sig"), "new_seg_key").distinct()
    return op.reconcile_signatures(pick(1), pick(2), "sig", "new_seg_key", "new_seg_key").groupBy("state").agg(F.count("*").alias("n"))


def headline_totals(s, d):
    t = table(s, d, "trees")
    return t.agg(F.count("*").alias("n"), F.count_distinct(plain_id("tree_id")).alias("n_trees"), F.sum(F.when(c("is_protected_notable") == 1, 1).otherwise(0)).alias("n_protected"), F.min("loaded_at").cast("string").alias("first"), F.max("loaded_at").cast("string").alias("last"))


def group_summary_median(s, d):
    a = table(s, d, "tree_assets_pilot")
    return a.groupBy("growth_setting").agg(F.count("*").alias("n"), F.round(F.sum("crown_volume_m3"), 3).alias("volume"), F.round(F.percentile("height_max_m", 0.5), 6).alias("median_h"), F.max("height_max_m").alias("max_h"))


def species_top_n(s, d):
    return op.top_values(table(s, d, "trees"), "species_common", 15)


def quantile_table_103(s, d):
    p = op.quantile_probabilities()
    q = op.quantile_table(table(s, d, "tree_assets_pilot"), ["growth_setting", "life_stage"], "height_max_m", p)
    return q.select("growth_setting", "life_stage", "n", F.transform("q", lambda x: F.round(x, 6)).alias("q"), "exact")


def keyed_counts_zero_filled(s, d):
    return op.keyed_counts(table(s, d, "tree_assets_pilot"), ["growth_setting"], "dominance_class", ["dominant", "co-dominant", "suppressed", "giant"]).withColumnRenamed("n_co-dominant", "n_co_dominant")


def one_per_crown(s, d):
    l = table(s, d, "tree_crown_lineage_v5")
    return op.first_per_key(l, ["new_seg_key"], [c("snapshot_no").desc(), c("intersection_m2").desc_nulls_last(), "old_seg_key", "old_tree_id"]).select("new_seg_key", "snapshot_no", "old_seg_key")


def crosstab_basis(s, d):
    return table(s, d, "tree_species_attributes").groupBy("growth_form", "growth_form_source").agg(F.count("*").alias("n"))


def dense_totals(s, d):
    t = table(s, d, "lineitem")
    return t.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.when(c("l_returnflag") == "A", 1).otherwise(0)).alias("n_a"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum(F.when(c("l_linestatus") == "O", c("l_quantity")).otherwise(0.0)), 2).alias("own"))


def members_json(s, d):
    m = table(s, d, "tree_crown_merge_pilot").where("cluster_id is not null").select("cluster_id", "created_at_utc", plain_id("member_tree_id").alias("member"), "member_source").distinct()
    return op.members_json(m, ["cluster_id", "created_at_utc"], ["member", "member_source"], ["member", "member_source"]).withColumn("created_at_utc", c("created_at_utc").cast("string"))


def grid_diversity(s, d):
    t = table(s, d, "trees").where("approx_x_m is not null and approx_y_m is not null and species_latin is not null").select(F.floor(c("approx_x_m") / 200).alias("gx"), F.floor(c("approx_y_m") / 200).alias("gy"), "species_latin")
    g = op.diversity(t, ["gx", "gy"], "species_latin")
    return g.select("gx", "gy", "n", "n_kinds", F.round("shannon", 6).alias("shannon"), F.round("simpson", 6).alias("simpson"))


def error_by_band(s, d):
    a = table(s, d, "tree_species_attributes").where("lidar_height_m is not null and mature_height_m is not null")
    e = op.error_summary(a.withColumn("band", F.floor(c("mature_height_m") / 5)), ["band"], c("mature_height_m"), c("lidar_height_m"))
    return e.select("band", "n", *[F.round(x, 6).alias(x) for x in ("rmse", "mae", "bias", "r")])


def conditional_rates(s, d):
    l = table(s, d, "lineitem")
    g = l.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.when(c("l_linestatus") == "O", 1).otherwise(0)).alias("covered"), F.avg(F.when(c("l_linestatus") == "O", F.when(c("l_quantity") > 25, 1.0).otherwise(0.0))).alias("rate"))
    return g.withColumn("rate", F.round("rate", 9))


def wilson_ci(s, d):
    g = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.when(c("o_orderstatus") == "F", 1).otherwise(0)).alias("k"))
    w = op.wilson(c("k"), c("n"))
    return g.select("o_orderpriority", "n", "k", F.round(w["lo"], 9).alias("lo"), F.round(w["hi"], 9).alias("hi"))


def cohort_quantiles_fallback(s, d):
    q = op.cohort_quantiles(table(s, d, "tree_assets_pilot").where("height_max_m is not null and crown_volume_m3 is not null").withColumn("band", F.floor(c("height_max_m") / 2)), "band", "crown_volume_m3", [0.1, 0.5, 0.9])
    return q.select("band", "n", F.transform("q", lambda x: F.round(x, 6)).alias("q"), "from_all")


def robust_mad(s, d):
    t = table(s, d, "nz_tree_points").where("height_m is not null")
    r = op.robust_spread(t, "source_slug", "height_m")
    return r.select("source_slug", "n", F.round("centre", 6).alias("centre"), F.round("spread", 6).alias("spread"))


def exclusive_p25(s, d):
    q = op.exclusive_quantile(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.25)
    return q.select("l_returnflag", "l_linestatus", "n", F.round("v", 4).alias("v"))


def upper_median_offset(s, d):
    return op.value_at(table(s, d, "tree_root_zone_pilot"), ["root_constraint_flag"], "dbh_cm", F.floor(c("n") / 2) + 1)


def reconcile_totals(s, d):
    t = table(s, d, "trees").select(F.when(c("approx_x_m").isNull() | c("approx_y_m").isNull(), "unassigned").otherwise("assigned").alias("part"))
    g = t.groupBy("part").agg(F.count("*").alias("n"))
    every = table(s, d, "trees").agg(F.count("*").alias("total")).scalar()
    p = g.agg(F.sum(F.when(c("part") == "assigned", c("n"))).alias("assigned"), F.sum(F.when(c("part") == "unassigned", c("n"))).alias("unassigned"))
    return p.withColumn("total", every).select("assigned", "unassigned", "total", (c("total") - c("assigned") - c("unassigned")).alias("difference"))


def vector_percentiles(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    p = [i / 20 for i in range(21)]
    q = o.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.array(*[F.lit(x) for x in p])).alias("q"))
    j = o.join(q, "o_orderpriority")
    return j.select("o_orderkey", F.round(op.percentile_in(c("o_totalprice"), c("q"), F.array(*[F.lit(x) for x in p])), 6).alias("pct"))


def stratified_sample_rows(s, d):
    return op.stratified_sample(table(s, d, "orders"), ["o_orderpriority"], 12, "o_orderkey").select("o_orderkey", "o_orderpriority")


def spaced_sample(s, d):
    return op.evenly_spaced(table(s, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey"), ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 11)


def five_number_summary(s, d):
    a = table(s, d, "tree_root_zone_pilot")
    return a.groupBy("life_stage").agg(F.count("dbh_cm").alias("n"), F.min("dbh_cm").alias("lo"), F.round(F.percentile("dbh_cm", F.lit(0.25)), 6).alias("q1"), F.round(F.median("dbh_cm"), 6).alias("med"), F.round(F.percentile("dbh_cm", F.lit(0.75)), 6).alias("q3"), F.max("dbh_cm").alias("hi"), F.round(F.avg("dbh_cm"), 6).alias("mean"))


def running_totals(s, d):
    o = table(s, d, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").alias("n"))
    # a row per day: bounded by the calendar
    return o.select("day", "n", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


def bootstrap_interval(s, d):
    return op.block_bootstrap(table(s, d, "trees").where("approx_x_m is not null").withColumn("block", F.concat_ws("_", F.floor(c("approx_x_m") / 100), F.floor(c("approx_y_m") / 100))).withColumn("v", F.when(c("species_latin").isNotNull(), 1.0).otherwise(0.0)), "block", "v")


def area_summary(s, d):
    a = _one(s, d, "tree_assets_pilot", ["height_max_m", "crown_volume_m3", "growth_setting", "life_stage"])
    flagged = F.coalesce(c("height_max_m") >= 55, F.lit(False))
    ok = F.when(~flagged, c("height_max_m"))
    tall = F.max_by(F.when(~flagged, c("tree_id")), F.struct(F.coalesce(ok, F.lit(-1.0)), c("tree_id")))
    return a.groupBy("growth_setting").agg(F.count("*").alias("n"), F.round(F.avg(ok), 6).alias("mean_h"), tall.alias("tallest"), F.round(F.sum("crown_volume_m3"), 3).alias("volume"), F.sum(F.when(c("life_stage") == "mature", 1).otherwise(0)).alias("n_mature"), F.sum(F.when(flagged, 1).otherwise(0)).alias("n_flagged"))


def primary_selection(s, d):
    m = table(s, d, "tree_crown_merge_pilot").where("cluster_id is not null").select("cluster_id", "created_at_utc", plain_id("member_tree_id").alias("m"), "is_primary", "member_source")
    return op.first_per_key(m, ["cluster_id", "created_at_utc"], [c("is_primary").desc_nulls_last(), c("member_source").asc_nulls_last(), "m"]).select("cluster_id", c("created_at_utc").cast("string").alias("run"), "m")


def winners_losers_rows(s, d):
    m = table(s, d, "tree_crown_merge_pilot").select(plain_id("member_tree_id").alias("m"), "cluster_id", "created_at_utc", "cluster_size").where("cluster_id is not null").distinct()
    m = m.withColumn("k", F.concat_ws("@", "cluster_id", c("created_at_utc").cast("string")))
    return op.winners_losers(m, ["m"], [c("cluster_size").desc_nulls_last(), "k"], "k")


def softmax_rank(s, d):
    l = current(table(s, d, "tree_crown_lineage_v5")).where("intersection_m2 is not null").select("new_seg_key", "old_seg_key", c("intersection_m2").alias("u")).distinct()
    l = l.groupBy("new_seg_key", "old_seg_key").agg(F.max("u").alias("u"))
    r = op.softmax_ranks(l.withColumn("u", c("u") / 10), ["new_seg_key"], "u", "old_seg_key")
    return r.select("new_seg_key", "old_seg_key", "rank", F.round("p_local", 9).alias("p"), F.round("margin", 6).alias("margin"))


def gaps_islands_runs(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(c("ts").cast("timestamp")) - F.lag(F.unix_micros(c("ts").cast("timestamp"))).over(w) > 3_600_000_000 * 6
    r = op.islands(e, ["user_id"], ["ts", "event_id"], gap, 12)
    return r.select("event_id", "user_id", "island", "place", "piece")


def group_transform(s, d):
    t = table(s, d, "nz_tree_points")
    g = t.groupBy("source_slug").agg(F.count("*").alias("size"), F.count_distinct("scientific_name").alias("n_names"), F.max("height_m").alias("max_h"))
    return t.select("point_id", "source_slug").join(g, "source_slug")


def top_k_per_parcel(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    return op.top_k(o.select("c_nationkey", "o_orderkey", "o_totalprice"), ["c_nationkey"], [c("o_totalprice").desc(), "o_orderkey"], 20)


def tallest_id(s, d):
    a = table(s, d, "tree_assets_pilot").where("height_max_m is not null and tree_id is not null").select("cluster_id", plain_id("tree_id").alias("t"), "height_max_m")
    return a.groupBy("cluster_id").agg(F.max(F.struct("height_max_m", "t")).alias("m")).select("cluster_id", "m.t", "m.height_max_m")


def newest_first(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "ts")
    return op.top_k(e, ["user_id"], [c("ts").desc(), c("event_id").desc()], 5).select("user_id", "event_id", "rank")


def next_leader_margin(s, d):
    a = _one(s, d, "tree_assets_pilot", ["height_max_m", "growth_setting"])
    r = op.leaders(a, ["growth_setting"], "height_max_m", "tree_id", 0.5)
    return r.select("growth_setting", "leader", "value", "next", F.round("margin", 6).alias("margin"), "within_margin")


def modal_value(s, d):
    n = table(s, d, "trees").where("owner_class is not null").groupBy("source_primary", "owner_class").agg(F.count("*").alias("k"))
    return n.groupBy("source_primary").agg(F.min(F.struct((-c("k")).alias("k"), "owner_class")).alias("m")).select("source_primary", "m.owner_class")


def union_current_legacy(s, d):
    l = table(s, d, "tree_crown_lineage_v5")
    new = current(l).select("new_seg_key", "intersection_m2")
    old = l.where("snapshot_no = 1").select("new_seg_key", "old_seg_key")
    return op.union_versions(new, old).groupBy("is_current").agg(F.count("*").alias("n"), F.count("intersection_m2").alias("n_area"), F.count("old_seg_key").alias("n_old"))


def except_both_ways(s, d):
    v = table(s, d, "v5_lineage_new_summary")
    a, b = (v.where(c("snapshot_no") == n).select("new_seg_key", "old_overlapping_crowns") for n in (1, 2))
    return op.except_both(a, b)


def upsert_replace(s, d):
    v = table(s, d, "v5_lineage_new_summary").select("snapshot_no", "new_seg_key", "old_overlapping_crowns").distinct()
    a, b = (v.where(c("snapshot_no") == n) for n in (1, 2))
    return op.upsert(a, b, "new_seg_key")


def insert_ignore(s, d):
    v = table(s, d, "v5_lineage_new_summary").select("snapshot_no", "new_seg_key", "old_overlapping_crowns").distinct()
    a, b = (v.where(c("snapshot_no") == n) for n in (1, 2))
    return op.upsert(a, b, "new_seg_key", replace=False)


def replace_source_slice(s, d):
    p = table(s, d, "nz_tree_points").select("source_slug", "point_id", "height_m")
    new = p.where("source_slug = 'plains_parks'").select("source_slug", "point_id", (c("height_m") * 2).alias("height_m"))
    return op.replace_slices(p, new, "source_slug")


def concat_sources(s, d):
    cols = lambda n, src: table(s, d, n).select(F.lit(src).alias("src"), plain_id("tree_id").alias("tree_id"), c("created_at_utc").cast("string").alias("at"))
    return union_all([cols("tree_assets_pilot", "assets"), cols("tree_root_zone_pilot", "roots")]).groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("tree_id").alias("ids"), F.max("at").alias("last"))


def difference_keys(s, d):
    v = table(s, d, "v5_lineage_new_summary").select("new_seg_key").distinct()
    return v.join(table(s, d, "tree_crown_lineage_v5").select("new_seg_key").distinct(), "new_seg_key", "left_anti")


def cascade_delete_counts(s, d):
    gone = table(s, d, "trees").where("retired_at is not null").select(plain_id("tree_id").alias("tree_id"))
    t = {n: table(s, d, n).withColumn("tree_id", plain_id("tree_id")) for n in ("trees", "tree_assets_pilot", "tree_root_zone_pilot")}
    left = op.cascade_delete(t, gone, "tree_id")
    return union_all([x.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, x in left.items()])


def bbox_filter(s, d):
    return table(s, d, "trees").where(c("approx_x_m").between(200, 700) & c("approx_y_m").between(300, 900)).select(plain_id("tree_id").alias("tree_id"), "approx_x_m", "approx_y_m").distinct()


def tile_owner(s, d):
    t = table(s, d, "trees").where("approx_x_m is not null and approx_y_m is not null")
    return t.groupBy(F.floor(c("approx_x_m") / 250).alias("tx"), F.floor(c("approx_y_m") / 250).alias("ty")).agg(F.count("*").alias("n"))


def flag_reasons(s, d):
    a = table(s, d, "tree_assets_pilot")
    r = op.reasons([(c("height_max_m") > 25, "tall"), (c("nearest_tree_m") < 2, "crowded"), (c("edge_tree") == 1, "edge"), (c("neighbours_25m").isNull(), "no neighbours known")])
    return a.groupBy(r.alias("reasons")).agg(F.count("*").alias("n"))


def rule_cascade(s, d):
    t = table(s, d, "trees")
    r = op.cascade([(c("retired_at").isNotNull(), "retired", "retired_at"), (c("is_protected_notable") == 1, "protected", "notable"), (c("source_primary").startswith("lidar"), "detected", "source"), (c("species_confidence") == "confirmed", "certain", "confidence")], (None, "none"))
    return t.groupBy(r["value"].alias("value"), r["basis"].alias("basis")).agg(F.count("*").alias("n"))


def evidence_tier(s, d):
    g = current(table(s, d, "tree_crown_lineage_v5")).groupBy("new_seg_key").agg(F.max("new_fraction").alias("f"), F.max("old_fraction").alias("o"), F.count("*").alias("n"))
    tier = F.when((c("f") >= 0.8) & (c("o") >= 0.5), "A").when(c("f") >= 0.5, "B").when(c("f") > 0, "C").otherwise("D")
    why = op.reasons([(c("f") < 0.5, "small share"), (c("o") < 0.5, "old crown split"), (c("n") > 3, "many parents")])
    return g.groupBy(tier.alias("tier"), why.alias("reasons")).agg(F.count("*").alias("n"))


def validated_population(s, d):
    import re

    name, cond = "trees", "source_primary = 'tree_register' and lon is not null"
    if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name) or ";" in cond:
        raise ValueError("not a population")
    return table(s, d, name).where(F.expr(cond)).groupBy("owner_class").agg(F.count("*").alias("n"))


def lineage_history(s, d):
    """Lineage history: the list of changes of each key over the snapshots."""
    v = table(s, d, "v5_lineage_new_summary").select("new_seg_key", "snapshot_no", "old_overlapping_crowns").distinct()
    g = v.groupBy("new_seg_key").agg(F.sort_array(F.collect_list(F.struct("snapshot_no", "old_overlapping_crowns"))).alias("h"))
    return g.select("new_seg_key", F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["snapshot_no"].cast("string"), x["old_overlapping_crowns"].cast("string"))), ",").alias("history"))


def first_delivery(s, d):
    """The earliest delivery of each tree, of equal ones the first by source."""
    t = table(s, d, "trees").select(plain_id("tree_id").alias("tree_id"), "loaded_at", "source_primary").where("tree_id is not null")
    return op.first_per_key(t, ["tree_id"], [c("loaded_at").asc_nulls_last(), c("source_primary").asc_nulls_last()])


def tile_rows(s, d):
    """Tiles read as one table with each key once."""
    return read_tiles(s, f"{d}/part.parquet", ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey", "p_name")


QUERIES = {f.__name__: f for f in (
    valuation_star_join, inner_using, anti_without_assets, semi_in_subquery, not_in_with_nulls, duplicate_key_guard, reference_fallback_lookup, genus_rollup, history_pick,
    signature_reconcile, headline_totals, group_summary_median, species_top_n, quantile_table_103, keyed_counts_zero_filled, one_per_crown, crosstab_basis, dense_totals,
    members_json, grid_diversity, error_by_band, conditional_rates, wilson_ci, cohort_quantiles_fallback, robust_mad, exclusive_p25, upper_median_offset, reconcile_totals,
    vector_percentiles, stratified_sample_rows, spaced_sample, five_number_summary, running_totals, bootstrap_interval, area_summary, primary_selection, winners_losers_rows,
    softmax_rank, gaps_islands_runs, group_transform, top_k_per_parcel, tallest_id, newest_first, next_leader_margin, modal_value, union_current_legacy, except_both_ways,
    upsert_replace, insert_ignore, replace_source_slice, concat_sources, difference_keys, cascade_delete_counts, bbox_filter, tile_owner, flag_reasons, rule_cascade,
    evidence_tier, validated_population, lineage_history, first_delivery, tile_rows,
)}

_P103 = "[" + ", ".join(str(x) for x in op.quantile_probabilities()) + "]"
_Z = 1.959963984540054
SQL = {
    "first_delivery": "select nullif(lower(trim(tree_id, ' ' || chr(9))), '') tree_id, loaded_at, source_primary from trees where nullif(trim(tree_id, ' ' || chr(9)), '') is not null qualify row_number() over (partition by lower(trim(tree_id, ' ' || chr(9))) order by loaded_at nulls last, source_primary nulls last) = 1",
    "tile_rows": "select p_brand, min(p_partkey) p_partkey, arg_min(p_name, p_partkey) p_name from part where p_brand is not null group by 1",
    "valuation_star_join": f"select t.tree_id, coalesce(a.height_max_m, g.lidar_height_m) height_m, r.dbh_cm from (select distinct {ID} tree_id from trees) t left join {_one_sql('tree_assets_pilot', ['height_max_m'])} a using (tree_id) left join {_one_sql('tree_root_zone_pilot', ['dbh_cm'])} r using (tree_id) left join {_one_sql('tree_species_attributes', ['lidar_height_m'])} g using (tree_id)",
    "inner_using": "select o_orderpriority, count(*) n, round(sum(l_quantity), 2) q from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "anti_without_assets": f"select distinct {ID} tree_id from trees where {ID} not in (select {ID} from tree_assets_pilot where tree_id is not null)",
    "semi_in_subquery": "select o_orderstatus, count(*) n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000) group by 1",
    "not_in_with_nulls": f"select distinct {ID} tree_id from tree_root_zone_pilot where {ID} is not null and {ID} not in (select {ID} from trees where {ID} is not null)",
    "duplicate_key_guard": "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1",
    "reference_fallback_lookup": f"with t as (select distinct {ID} tree_id, species_latin from trees where species_latin is not null), r as (select * from itree_species_ref where taxon_rank = 'species'), g as (select genus, max(mature_height_m) h from r group by 1) select t.*, coalesce(r.mature_height_m, g.h, 12.0) mature, case when r.mature_height_m is not null then 'species' when g.h is not null then 'genus' else 'model' end mature_source from t left join r on species_latin = scientific_name left join g on split_part(species_latin, ' ', 1) = g.genus",
    "genus_rollup": "with n as (select genus, growth_form, count(*) k, max(mature_height_m) h from itree_species_ref where taxon_rank = 'species' group by 1, 2) select genus, first(growth_form order by k desc, growth_form) modal_form, max(h) max_height, sum(k)::bigint n from n group by 1",
    "history_pick": f"select distinct {ID} tree_id, coalesce(height_p95_m, height_p50_m) h, case when height_p95_m is not null then 8 when height_p50_m is not null then 11 end::int span from tree_assets_pilot",
    "headline_totals": f"select count(*) n, count(distinct {ID}) n_trees, sum(case when is_protected_notable = 1 then 1 else 0 end)::bigint n_protected, min(loaded_at)::varchar as first, max(loaded_at)::varchar as last from trees",
    "group_summary_median": "select growth_setting, count(*) n, round(sum(crown_volume_m3), 3) volume, round(quantile_cont(height_max_m, 0.5), 6) median_h, max(height_max_m) max_h from tree_assets_pilot group by 1",
    "species_top_n": "with g as (select coalesce(nullif(trim(species_common), ''), 'Unknown') v, count(*) n from trees group by 1), k as (select v, n, row_number() over (order by n desc, v) p from g where v <> 'Unknown') select v as \"value\", n, 0 place from g where v = 'Unknown' union all select v, n, p::int from k where p <= 15",
    "quantile_table_103": f"with g as (select growth_setting, life_stage, count(height_max_m) n, quantile_cont(height_max_m::double, {_P103}) q, list_sort(list(height_max_m::double)) e from tree_assets_pilot where height_max_m is not null group by 1, 2) select growth_setting, life_stage, n, case when n > 60 then list_transform(q, lambda x: round(x, 6)) end q, case when n <= 60 then e end exact from g",
    "keyed_counts_zero_filled": "select growth_setting, count(*) filter (where dominance_class = 'dominant') n_dominant, count(*) filter (where dominance_class = 'co-dominant') n_co_dominant, count(*) filter (where dominance_class = 'suppressed') n_suppressed, 0::bigint n_giant from tree_assets_pilot group by 1",
    "one_per_crown": "select new_seg_key, snapshot_no, old_seg_key from tree_crown_lineage_v5 qualify row_number() over (partition by new_seg_key order by snapshot_no desc, intersection_m2 desc nulls last, old_seg_key, old_tree_id nulls first) = 1",
    "crosstab_basis": "select growth_form, growth_form_source, count(*) n from tree_species_attributes group by 1, 2",
    "dense_totals": "select l_suppkey, count(*) n, count(*) filter (where l_returnflag = 'A') n_a, round(sum(l_quantity), 2) q, round(sum(case when l_linestatus = 'O' then l_quantity else 0 end), 2) own from lineitem group by 1",
    "grid_diversity": "with n as (select floor(approx_x_m / 200)::bigint gx, floor(approx_y_m / 200)::bigint gy, species_latin, count(*) k from trees where approx_x_m is not null and approx_y_m is not null and species_latin is not null group by 1, 2, 3), t as (select gx, gy, sum(k)::bigint n, count(*) n_kinds, sum(k * ln(k)) a, sum(k * k) b from n group by 1, 2) select gx, gy, n, n_kinds, round(ln(n) - a / n, 6) shannon, round(1 - b / (n * n), 6) simpson from t",
    "error_by_band": "with t as (select floor(mature_height_m / 5)::bigint band, mature_height_m t, lidar_height_m g, lidar_height_m - mature_height_m d from tree_species_attributes where lidar_height_m is not null and mature_height_m is not null) select band, count(*) n, round(sqrt(avg(d * d)), 6) rmse, round(avg(abs(d)), 6) mae, round(avg(d), 6) bias, round(covar_pop(t, g) / nullif(stddev_pop(t) * stddev_pop(g), 0), 6) r from t group by 1 having count(*) >= 30",
    "conditional_rates": "select l_returnflag, count(*) n, count(*) filter (where l_linestatus = 'O') covered, round(avg(case when l_linestatus = 'O' then case when l_quantity > 25 then 1.0 else 0.0 end end), 9) rate from lineitem group by 1",
    "wilson_ci": f"with g as (select o_orderpriority, count(*) n, count(*) filter (where o_orderstatus = 'F') k from orders group by 1), m as (select *, k / n p, {_Z}::double z from g), w as (select *, (p + z * z / (2 * n)) / (1 + z * z / n) mid, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) half from m) select o_orderpriority, n, k, round(greatest(mid - half, 0), 9) lo, round(least(mid + half, 1), 9) hi from w",
    "cohort_quantiles_fallback": "with t as (select floor(height_max_m / 2)::bigint band, crown_volume_m3 v from tree_assets_pilot where height_max_m is not null and crown_volume_m3 is not null), g as (select band, count(*) n, quantile_cont(v, [0.1, 0.5, 0.9]) q from t group by 1), a as (select quantile_cont(v, [0.1, 0.5, 0.9]) qa from t) select band, n, list_transform(case when n >= 50 then q else qa end, lambda x: round(x, 6)) q, n < 50 from_all from g, a",
    "robust_mad": "with m as (select source_slug, count(height_m) n, median(height_m) c from nz_tree_points where height_m is not null group by 1 having count(*) >= 15), d as (select p.source_slug, any_value(n) n, any_value(c) c, median(abs(height_m - c)) mad from nz_tree_points p join m using (source_slug) where height_m is not null group by 1) select source_slug, n, round(c, 6) centre, round(greatest(1.4826 * mad, 0.15), 6) spread from d",
    "exclusive_p25": "with r as (select l_returnflag, l_linestatus, l_extendedprice v, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice) i, count(*) over (partition by l_returnflag, l_linestatus) n from lineitem), h as (select *, 0.25 * (n + 1) h, least(greatest(floor(0.25 * (n + 1)), 1), greatest(n - 1, 1)) j from r) select l_returnflag, l_linestatus, n, round(max(case when i = j then v end) + (max(case when i = least(j + 1, n) then v end) - max(case when i = j then v end)) * max(h - j), 4) v from h group by 1, 2, 3",
    "upper_median_offset": "select root_constraint_flag, n, v from (select root_constraint_flag, dbh_cm v, row_number() over (partition by root_constraint_flag order by dbh_cm) i, count(*) over (partition by root_constraint_flag) n from tree_root_zone_pilot where dbh_cm is not null) where i = n // 2 + 1",
    "reconcile_totals": "select count(*) filter (where approx_x_m is not null and approx_y_m is not null) assigned, count(*) filter (where approx_x_m is null or approx_y_m is null) unassigned, count(*) total, 0::bigint difference from trees",
    "five_number_summary": "select life_stage, count(dbh_cm) n, min(dbh_cm) lo, round(quantile_cont(dbh_cm, 0.25), 6) q1, round(median(dbh_cm), 6) med, round(quantile_cont(dbh_cm, 0.75), 6) q3, max(dbh_cm) hi, round(avg(dbh_cm), 6) mean from tree_root_zone_pilot group by 1",
    "running_totals": "with o as (select o_orderdate::date::varchar as day, count(*) n from orders group by 1) select day, n, sum(n) over (order by day)::bigint upto from o",
    "area_summary": f"with a as (select tree_id, height_max_m h, crown_volume_m3 v, growth_setting, life_stage from {_one_sql('tree_assets_pilot', ['height_max_m', 'crown_volume_m3', 'growth_setting', 'life_stage'])}) select growth_setting, count(*) n, round(avg(case when h < 55 then h end), 6) mean_h, (list(case when coalesce(h < 55, true) then tree_id end order by case when h < 55 then h else -1 end desc, tree_id desc))[1] tallest, round(sum(v), 3) volume, count(*) filter (where life_stage = 'mature') n_mature, count(*) filter (where h >= 55) n_flagged from a group by 1",
    "primary_selection": "with m as (select cluster_id, created_at_utc, nullif(lower(trim(member_tree_id, ' ' || chr(9))), '') m, is_primary, member_source from tree_crown_merge_pilot where cluster_id is not null) select cluster_id, created_at_utc::varchar run, m from m qualify row_number() over (partition by cluster_id, created_at_utc order by is_primary desc nulls last, member_source asc nulls last, m) = 1",
    "winners_losers_rows": "with m as (select distinct nullif(lower(trim(member_tree_id, ' ' || chr(9))), '') m, cluster_id || '@' || created_at_utc::varchar k, cluster_size from tree_crown_merge_pilot where cluster_id is not null), r as (select *, row_number() over (partition by m order by cluster_size desc nulls last, k) i, count(*) over (partition by m) n from m) select a.m, b.k winner, a.k loser from r a join r b on a.m = b.m and b.i = 1 where a.i > 1",
    "softmax_rank": "with l as (select new_seg_key, old_seg_key, max(intersection_m2) / 10 u from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5) and intersection_m2 is not null group by 1, 2), r as (select *, row_number() over w as rank, exp(u - max(u) over (partition by new_seg_key)) e, u - lead(u) over w margin from l window w as (partition by new_seg_key order by u desc, old_seg_key)), p as (select *, e / sum(e) over (partition by new_seg_key) p from r) select new_seg_key, old_seg_key, rank::int as rank, round(p, 9) p, round(margin, 6) margin from p where rank <= 3",
    "gaps_islands_runs": "with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hours or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end b from events), i as (select *, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint island from e), p as (select *, row_number() over (partition by user_id, island order by ts, event_id) place from i) select event_id, user_id, island, place::int place, ((place - 1) // 12 + 1)::int piece from p",
    "group_transform": "select point_id, source_slug, count(*) over w as size, n_names, max(height_m) over w max_h from nz_tree_points join (select source_slug, count(distinct scientific_name) n_names from nz_tree_points group by 1) using (source_slug) window w as (partition by source_slug)",
    "top_k_per_parcel": "select c_nationkey, o_orderkey, o_totalprice, row_number() over (partition by c_nationkey order by o_totalprice desc, o_orderkey)::int as rank from orders join customer on o_custkey = c_custkey qualify rank <= 20",
    "tallest_id": "with a as (select cluster_id, nullif(lower(trim(tree_id, ' ' || chr(9))), '') t, height_max_m from tree_assets_pilot where height_max_m is not null and tree_id is not null) select cluster_id, t, height_max_m from a qualify row_number() over (partition by cluster_id order by height_max_m desc, t desc) = 1",
    "newest_first": "select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc)::int as rank from events qualify rank <= 5",
    "next_leader_margin": f"with a as (select * from {_one_sql('tree_assets_pilot', ['height_max_m', 'growth_setting'])} where height_max_m is not null), r as (select *, row_number() over (partition by growth_setting order by height_max_m desc, tree_id) i from a), g as (select growth_setting, max(tree_id) filter (where i = 1) leader, max(height_max_m) filter (where i = 1) as value, max(height_max_m) filter (where i = 2) as next from r where i <= 2 group by 1) select growth_setting, leader, value, next, round(value - next, 6) margin, coalesce(value - next < 0.5, false) within_margin from g",
    "modal_value": "with n as (select source_primary, owner_class, count(*) k from trees where owner_class is not null group by 1, 2) select source_primary, first(owner_class order by k desc, owner_class) owner_class from n group by 1",
    "union_current_legacy": "select 1 is_current, count(*) n, count(intersection_m2) n_area, 0::bigint n_old from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5) union all select 0, count(*), 0, count(old_seg_key) from tree_crown_lineage_v5 where snapshot_no = 1",
    "except_both_ways": "with a as (select new_seg_key, old_overlapping_crowns from v5_lineage_new_summary where snapshot_no = 1), b as (select new_seg_key, old_overlapping_crowns from v5_lineage_new_summary where snapshot_no = 2) select *, 'a' only_in from (select * from a except select * from b) union all select *, 'b' from (select * from b except select * from a)",
    "upsert_replace": "with v as (select distinct snapshot_no, new_seg_key, old_overlapping_crowns from v5_lineage_new_summary) select * from v where snapshot_no = 2 union all select * from v where snapshot_no = 1 and new_seg_key not in (select new_seg_key from v where snapshot_no = 2)",
    "insert_ignore": "with v as (select distinct snapshot_no, new_seg_key, old_overlapping_crowns from v5_lineage_new_summary) select * from v where snapshot_no = 1 union all select * from v where snapshot_no = 2 and new_seg_key not in (select new_seg_key from v where snapshot_no = 1)",
    "replace_source_slice": "select source_slug, point_id, case when source_slug = 'plains_parks' then height_m * 2 else height_m end height_m from nz_tree_points where source_slug is not null",
    "concat_sources": f"select src, count(*) n, count(distinct {ID}) ids, max(cr)::varchar as last from (select 'assets' src, tree_id, created_at_utc cr from tree_assets_pilot union all select 'roots', tree_id, created_at_utc from tree_root_zone_pilot) group by 1",
    "difference_keys": "select distinct new_seg_key from v5_lineage_new_summary where new_seg_key not in (select new_seg_key from tree_crown_lineage_v5)",
    "cascade_delete_counts": f"with gone as (select {ID} k from trees where retired_at is not null) select 'trees' as name, count(*) n from trees where {ID} not in (select k from gone) union all select 'tree_assets_pilot', count(*) from tree_assets_pilot where {ID} is null or {ID} not in (select k from gone) union all select 'tree_root_zone_pilot', count(*) from tree_root_zone_pilot where {ID} is null or {ID} not in (select k from gone)",
    "bbox_filter": f"select distinct {ID} tree_id, approx_x_m, approx_y_m from trees where approx_x_m between 200 and 700 and approx_y_m between 300 and 900",
    "tile_owner": "select floor(approx_x_m / 250)::bigint tx, floor(approx_y_m / 250)::bigint ty, count(*) n from trees where approx_x_m is not null and approx_y_m is not null group by 1, 2",
    "flag_reasons": "select concat_ws('; ', case when height_max_m > 25 then 'tall' end, case when nearest_tree_m < 2 then 'crowded' end, case when edge_tree = 1 then 'edge' end, case when neighbours_25m is null then 'no neighbours known' end) reasons, count(*) n from tree_assets_pilot group by 1",
    "rule_cascade": "select case when retired_at is not null then 'retired' when is_protected_notable = 1 then 'protected' when starts_with(source_primary, 'lidar') then 'detected' when species_confidence = 'confirmed' then 'certain' end as value, case when retired_at is not null then 'retired_at' when is_protected_notable = 1 then 'notable' when starts_with(source_primary, 'lidar') then 'source' when species_confidence = 'confirmed' then 'confidence' else 'none' end basis, count(*) n from trees group by 1, 2",
    "evidence_tier": "with g as (select new_seg_key, max(new_fraction) f, max(old_fraction) o, count(*) n from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5) group by 1) select case when f >= 0.8 and o >= 0.5 then 'A' when f >= 0.5 then 'B' when f > 0 then 'C' else 'D' end tier, concat_ws('; ', case when f < 0.5 then 'small share' end, case when o < 0.5 then 'old crown split' end, case when n > 3 then 'many parents' end) reasons, count(*) n from g group by 1, 2",
    "validated_population": "select owner_class, count(*) n from trees where source_primary = 'tree_register' and lon is not null group by 1",
    "lineage_history": "with v as (select distinct new_seg_key, snapshot_no, old_overlapping_crowns from v5_lineage_new_summary) select new_seg_key, string_agg(snapshot_no || ':' || old_overlapping_crowns, ',' order by snapshot_no) history from v group by 1",
    "members_json": "with m as (select distinct cluster_id, created_at_utc, nullif(lower(trim(member_tree_id, ' ' || chr(9))), '') m, member_source s from tree_crown_merge_pilot where cluster_id is not null) select cluster_id, created_at_utc::varchar created_at_utc, '[' || string_agg('{\"member\":\"' || m || '\"' || coalesce(',\"member_source\":\"' || s || '\"', '') || '}', ',' order by m, s nulls first) || ']' members, count(*) n from m group by 1, 2",
    "vector_percentiles": "with q as (select o_orderpriority, unnest(quantile_cont(o_totalprice, [i / 20.0 for i in range(21)]::double[])) q, unnest([i / 20.0 for i in range(21)]) p from orders group by 1), j as (select o_orderkey, o_totalprice v, q.q, p from orders join q using (o_orderpriority)), g as (select o_orderkey, v, min(p) filter (q = v) e0, max(p) filter (q = v) e1, max(q) filter (q < v) qa, max(p) filter (q < v) pa, min(q) filter (q > v) qb, min(p) filter (q > v) pb from j group by 1, 2) select o_orderkey, round((case when e0 is not null then (e0 + e1) * 50 when qa is null then 0 when qb is null then 100 else (pa + (pb - pa) * (v - qa) / (qb - qa)) * 100 end)::double, 6) pct from g",
    "signature_reconcile": "with l as (select snapshot_no s, coalesce(nullif(lower(trim(old_tree_id, ' ' || chr(9))), ''), '-') || coalesce('|' || case when intersection_m2 is not null then printf('%.1f', round(intersection_m2, 1)) end, '') sig, new_seg_key k from tree_crown_lineage_v5 where snapshot_no in (1, 2) group by all), o as (select sig, count(*) n, min(k) k from l where s = 1 group by 1), n as (select sig, count(*) n, min(k) k from l where s = 2 group by 1) select case when greatest(coalesce(o.n, 0), coalesce(n.n, 0)) > 1 then 'ambiguous' when n.n is null then 'gone' when o.n is null then 'added' when o.k = n.k then 'same' else 'renumbered' end state, count(*) n from o full join n using (sig) group by 1",
    "spaced_sample": "with r as (select o_orderpriority, o_totalprice, o_orderkey, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) - 1 r, count(*) over (partition by o_orderpriority) n from orders) select o_orderpriority, o_totalprice, o_orderkey from r where n <= 11 or exists (select 1 from (select unnest(range(11)) i) where floor(i * (n - 1) / 10 + 0.5) = r)",
}
