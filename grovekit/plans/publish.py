"""Queries of filters, search, shards, key resolution and release checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import filters, ids, text
from grovekit.functions.geo import meant_position
from grovekit.operators import publish as op
from grovekit.operators import relational as rel
from grovekit.operators import spatial as sp
from grovekit.plans.scalars import ADDRESS_SQL, STREET_SQL, _address
from grovekit.plans.spatial import CUST, ID, PIP, XY, XY_SQL, customers, points, regions
from grovekit.session import bounded_collect, current, plain_id, table

c = F.col

FILTER = ["all",
    ["in", ["get", "source_primary"], ["literal", ["tree_register", "park_survey", "notable_overlay"]]],
    ["!=", ["coalesce", ["get", "species_confidence"], "unknown"], "guessed"],
    ["any", ["==", ["to-number", ["get", "is_protected_notable"]], 1], [">=", ["coalesce", ["get", "lat"], -90], -37.235]],
    ["!", ["in", ["coalesce", ["get", "owner_class"], "-"], ["literal", ["-", "?", "unknown"]]]],
    ["match", ["get", "record_role"], ["authoritative_inventory", "public_observation"], True, False],
    ["case", ["has", "retired_at"], False, True]]


def filter_dsl_eval(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trees")
    return t.where(filters.compile_filter(FILTER, t.columns)).groupBy("source_primary", "owner_class").agg(F.count("*").alias("n"))


def filter_selection(s, d):
    t = table(s, d, "trees")
    every = ["tree_register", "park_survey"]
    none, some, full = (filters.compile_filter(filters.selection("source_primary", x, every), t.columns) for x in ([], every[:1], every))
    return t.agg(F.count(F.when(none, 1)).alias("n_none"), F.count(F.when(some, 1)).alias("n_some"), F.count(F.when(full, 1)).alias("n_all"))


def sharded_details(s, d):
    t = table(s, d, "trees").select(plain_id("tree_id").alias("tree_id"), "species_latin", "owner_class").distinct()
    t = rel.first_per_key(t, ["tree_id"], [c("species_latin").asc_nulls_last(), c("owner_class").asc_nulls_last()])
    return op.key_shards(t, "tree_id", ["species_latin", "owner_class"], 256).select("bucket", "path", "n", F.length("body").cast("long").alias("chars"))


def shard_reconciliation(s, d):
    t = table(s, d, "trees").select(plain_id("tree_id").alias("tree_id")).distinct()
    k = op.key_shards(t, "tree_id", ["tree_id"], 256)
    back = k.select(F.explode(F.map_keys(F.from_json("body", "map<string,struct<tree_id:string>>"))).alias("key"), "bucket")
    return back.agg(F.count("*").alias("n"), F.sum(F.when(ids.fnv1a(c("key")) % 256 == c("bucket"), 1).otherwise(0)).alias("n_right"))


def nearby_cells(s, d):
    at = meant_position(c("lon"), c("lat"), 160.0, -55.0, -25.0)
    p = table(s, d, "trees").select(plain_id("tree_id").alias("tree_id"), at.alias("at")).where("at is not null").select("tree_id", "at.lon", "at.lat").distinct()
    return op.cell_index(p, "lon", "lat", ["tree_id"], 1000).select("cell", "n", F.element_at("members", 1)["tree_id"].alias("first"))


def address_shards(s, d):
    """Size of each prefix shard of the address index."""
    a = op.address_index(_address(s, d), "street", "suburb", "number", "unit")
    return a.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("street_norm").alias("n_streets"), F.min("street_norm").alias("first"))


def address_search(s, d):
    a = op.address_index(_address(s, d), "street", "suburb", "number", "unit")
    # as typed: a beginning of the number and street, at times with a unit, and a suburb in part or of elsewhere
    street = F.when(c("k") % 3 == 0, F.substring("street", 1, 8)).otherwise(c("street"))
    suburb = F.when(c("k") % 4 == 0, F.lit(", Nowhere")).when(c("k") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(", "), F.substring("suburb", 1, 4)))
    q = _address(s, d).where("k % 100 = 0").select(F.concat(F.when(c("unit").isNotNull(), F.lit("Unit 3, ")).otherwise(""), c("number"), F.lit(" "), street, suburb).alias("q"))
    return op.address_search(q, "q", a, "k")


def universal_search(s, d):
    q = table(s, d, "trees").select(c("species_common_raw").alias("q")).where("q is not null").distinct()
    r = table(s, d, "itree_species_ref")
    items = r.where("common_name is not null").select("taxon_id", c("common_name").alias("label"), F.lit("common").alias("kind")).unionByName(r.select("taxon_id", c("scientific_name").alias("label"), F.lit("latin").alias("kind")))
    return op.ranked_search(q, "q", items, "label", "kind", "taxon_id", 3, 5, 70.0)


def alias_resolve(s, d):
    l = current(table(s, d, "tree_crown_lineage_v5"))
    t = op.alias_table(l, "old_seg_key", "new_seg_key", l, "new_seg_key")
    asked = table(s, d, "tree_crown_lineage_v5").where("snapshot_no = 1").select("old_seg_key").distinct()
    return op.resolve(asked, "old_seg_key", t).groupBy("status").agg(F.count("*").alias("n"))


def species_maxima_badges(s, d):
    a = table(s, d, "tree_assets_pilot").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.max("height_max_m").alias("h"), F.max("crown_volume_m3").alias("v"))
    t = table(s, d, "trees").where("species_latin is not null").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.min("species_latin").alias("species"))
    x = t.join(a, "tree_id").select("tree_id", "species", F.expr("stack(2, 'height', h, 'volume', v)").alias("measure", "value"))
    return rel.leaders(x, ["species", "measure"], "value", "tree_id", 0.5).select("species", "measure", "leader", "value", "next", "within_margin")


def comparison_board_class(s, d):
    o = customers(s, d)
    first = sp.pip_join(o, ("k", "x", "y"), regions(s, d), "rid", "rings", 250.0, "first", "rank")
    j = o.join(first.select(c("p_id").alias("k"), "region_id"), "k")
    q = rel.quantile_table(j, ["region_id", "seg"], "v", [0.1, 0.25, 0.5, 0.75, 0.9], 5)
    return q.select("region_id", "seg", "n", F.transform("q", lambda x: F.round(x, 4)).alias("q"), "exact")


def parcel_summary(s, d):
    o = customers(s, d)
    j = sp.pip_join(o, ("k", "x", "y"), regions(s, d), "rid", "rings", 250.0, "smallest").select(c("p_id").alias("k"), "region_id").join(o, "k")
    g = j.groupBy("region_id").agg(F.count("*").alias("n"), F.sum(F.when(c("v") > 0, 1).otherwise(0)).alias("n_confident"), F.round(F.sum("v"), 2).alias("value"), F.max(F.struct("v", "k"))["k"].alias("top"))
    best = rel.top_k(j.select("region_id", "k", "v"), ["region_id"], [c("v").desc(), "k"], 3).groupBy("region_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"].cast("string")), ",").alias("best"))
    return g.join(best, "region_id")


def training_manifest(s, d):
    """Weak labels per point: taxon scope, conflicts within 1 m cells, fold, and what is eligible."""
    t = table(s, d, "trees").where("approx_x_m is not null and approx_y_m is not null").select(plain_id("tree_id").alias("tree_id"), "approx_x_m", "approx_y_m", text.taxon_parts(c("species_latin")).alias("tx"))
    t = t.groupBy("tree_id").agg(F.min("approx_x_m").alias("x"), F.min("approx_y_m").alias("y"), F.max(F.when(c("tx.scope") == "species_exact", c("tx.species"))).alias("species"))
    n = t.where("species is not null").groupBy(F.floor("x").alias("i"), F.floor("y").alias("j")).agg(F.count_distinct("species").alias("k"))
    j = t.withColumn("i", F.floor("x")).withColumn("j", F.floor("y")).join(n, ["i", "j"], "left")
    state = F.when(c("species").isNull(), "no_label").when(c("k") > 1, "conflict").when(ids.near_block_edge(c("x"), c("y"), 200.0, 15.0), "buffer_excluded").otherwise(ids.block_fold(c("x"), c("y"), 200.0))
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def block_splits(s, d):
    p = points(s, d).groupBy(F.concat_ws("_", F.floor(c("x") / 200), F.floor(c("y") / 200)).alias("block")).agg(F.count("*").alias("n"))
    rows = [(r["block"], r["n"]) for r in bounded_collect(p, 1_000_000, "blocks")]  # the running assignment is sequential by nature
    got = rel.deficit_splits(rows, {"train": 0.7, "calibration": 0.15, "test": 0.15})
    return s.createDataFrame([(b, n, got[b]) for b, n in rows], "block string, n long, split string")


def genus_agreement(s, d):
    g = lambda x: text.taxon_parts(c(x))["genus"]
    t = table(s, d, "trees").select(g("species_latin").alias("a"), g("species_latin_raw").alias("b")).where("a is not null and b is not null")
    return t.groupBy((c("a") == c("b")).alias("agree")).agg(F.count("*").alias("n"))


def height_plausibility(s, d):
    a = table(s, d, "tree_species_attributes")
    v = F.when(c("mature_height_m").isNull() | c("lidar_height_m").isNull(), "not_assessed").when(c("lidar_height_m") > c("mature_height_m") * 1.3, "implausible").otherwise("plausible")
    return a.groupBy(v.alias("state")).agg(F.count("*").alias("n"))


def release_gates(s, d):
    t = table(s, d, "trees").withColumn("id", plain_id("tree_id"))
    m = table(s, d, "tree_crown_merge_pilot")
    return op.gates([
        ("trees have an id", "error", t.where("id is null")),
        ("retired after loaded", "error", t.where("retired_at < loaded_at")),
        ("positions on the globe", "warning", t.where("lon is not null and (abs(lon) > 180 or abs(lat) > 90)")),
        ("one delivery per tree", "warning", rel.duplicate_keys(t, ["id"])),
        ("assets name trees", "warning", table(s, d, "tree_assets_pilot").select(plain_id("tree_id").alias("id")).where("id is not null").join(t.select("id"), "id", "left_anti")),
        ("cluster sizes positive", "error", m.where("cluster_size <= 0")),
    ])


def table_fingerprint(s, d):
    return op.fingerprint(table(s, d, "lineitem"))


def conflict_reasons(s, d):
    m = table(s, d, "tree_crown_merge_pilot")
    n = m.where("cluster_id is not null").groupBy("cluster_id", "created_at_utc").agg(F.count_distinct(plain_id("member_tree_id")).alias("n"), F.max("cluster_size").alias("told"), F.sum(F.coalesce("is_primary", F.lit(0))).alias("p"), F.count_distinct(plain_id("primary_tree_id")).alias("k"))
    r = rel.reasons([(c("n") != c("told"), "wrong size"), (c("p") == 0, "no primary"), (c("p") > 1, "several primaries"), (c("k") > 1, "contradicting ids")])
    return n.groupBy(r.alias("reasons")).agg(F.count("*").alias("n"))


def view_states(s, d):
    a = _address(s, d)
    u = op.view_url([("q", c("street")), ("s", c("suburb")), ("u", c("unit"))])
    v = op.view_state(u, ["q", "s", "u"])
    return a.select("k", u.alias("url"), (v["q"].eqNullSafe(c("street")) & v["u"].eqNullSafe(c("unit"))).alias("same"))


def record_pages(s, d):
    """A page per tree: the representative record with its side tables and checks."""
    one = lambda n, cols: rel.first_per_key(table(s, d, n).select(plain_id("tree_id").alias("tree_id"), "created_at_utc", *cols).where("tree_id is not null"), ["tree_id"], [c("created_at_utc").desc(), *[c(x).desc_nulls_last() for x in cols]]).drop("created_at_utc")
    t = table(s, d, "trees").groupBy(plain_id("tree_id").alias("tree_id")).agg(F.count("*").alias("n_records"), F.max(F.struct("loaded_at", "source_primary"))["source_primary"].alias("source"))
    j = rel.star_join(t, [(one("tree_assets_pilot", ["height_max_m"]), "tree_id"), (one("tree_root_zone_pilot", ["dbh_cm"]), "tree_id")])
    page = F.to_json(F.struct("source", c("height_max_m").alias("height"), c("dbh_cm").alias("dbh")))
    return j.select("tree_id", "n_records", rel.reasons([(c("height_max_m").isNull(), "no height"), (c("dbh_cm").isNull(), "no trunk")]).alias("checks"), F.length(page).alias("chars"))


def feature_lines(s, d):
    t = table(s, d, "tree_low_canopy_candidates").where("lon is not null").select("candidate_id", "lon", "lat", "height_m", "gli").distinct()
    return t.select("candidate_id", op.feature_json(["candidate_id", "height_m", "gli"], "lon", "lat", 3, ["height_m", "gli"]).alias("feature"))


def unified_points(s, d):
    """Loosely named source attributes brought to one schema."""
    p = table(s, d, "nz_tree_points")
    pick = lambda *names: text.resolve_field(p.columns, list(names))
    g = F.get_json_object("properties_json", "$.crew").try_cast("int")
    return p.select(c(pick("pointid")).alias("id"), F.coalesce(text.clean_text(c(pick("botanical", "scientific"))), text.clean_text(c(pick("species or name")))).alias("name"), text.number_of(c(pick("height"))).alias("height"), g.alias("crew"))


def incremental_rebuild(s, d):
    v = table(s, d, "v5_lineage_new_summary").select("snapshot_no", "new_seg_key", "old_overlapping_crowns").distinct()
    old, new = (v.where(c("snapshot_no") == n).select("new_seg_key", "old_overlapping_crowns") for n in (3, 4))
    changed = rel.except_both(old, new).select("new_seg_key")
    return op.incremental(old, changed, "new_seg_key", new)


def street_nearby(s, d):
    """Trees of other owners within 20 m of each customer, nearest first, at most 50."""
    j = sp.near_join(customers(s, d), points(s, d), ("k", "x", "y"), XY, 20.0).select("a_id", "b_id", "d")
    return rel.top_k(j, ["a_id"], ["d", "b_id"], 50).select("a_id", "b_id", "rank")


QUERIES = {f.__name__: f for f in (
    filter_dsl_eval, filter_selection, sharded_details, shard_reconciliation, nearby_cells, address_search, address_shards, universal_search, alias_resolve, species_maxima_badges,
    comparison_board_class, parcel_summary, training_manifest, block_splits, genus_agreement, height_plausibility, release_gates, table_fingerprint, conflict_reasons, view_states,
    record_pages, feature_lines, unified_points, incremental_rebuild, street_nearby,
)}

_G = lambda x: f"case when lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' .')) not in ('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', '<blank>', '-', '?') and regexp_full_match(split_part(trim(regexp_replace(replace({x}, '_', ' '), '\\s+', ' ', 'g'), ' .'), ' ', 1), '[A-Z][a-z]+') then split_part(trim(regexp_replace(replace({x}, '_', ' '), '\\s+', ' ', 'g'), ' .'), ' ', 1) end"
SQL = {
    "filter_dsl_eval": "select source_primary, owner_class, count(*) n from trees where source_primary in ('tree_register', 'park_survey', 'notable_overlay') and coalesce(species_confidence, 'unknown') <> 'guessed' and (coalesce(is_protected_notable = 1, false) or coalesce(lat, -90) >= -37.235) and coalesce(owner_class, '-') not in ('-', '?', 'unknown') and record_role in ('authoritative_inventory', 'public_observation') and retired_at is null group by 1, 2",
    "filter_selection": "select 0::bigint n_none, count(*) filter (where source_primary = 'tree_register') n_some, count(*) n_all from trees",
    "shard_reconciliation": f"select count(distinct {ID}) n, count(distinct {ID}) n_right from trees",
    "address_shards": f"with {ADDRESS_SQL}, n as (select replace({STREET_SQL}, '$', '') s from addr) select substr(replace(s, ' ', ''), 1, 2) shard, count(*) n, count(distinct s) n_streets, min(s) as first from n group by 1",
    "nearby_cells": f"with m as (select {ID} tree_id, list_filter([{{'x': lon, 'y': lat}}, {{'x': lat, 'y': lon}}, {{'x': lon, 'y': -lat}}, {{'x': lat, 'y': -lon}}], lambda p: not isnan(p.x) and not isnan(p.y) and (p.x between 160 and 180 or p.x between -180 and -175) and p.y between -55 and -25)[1] p from trees), t as (select distinct tree_id, p.x lon, p.y lat from m where p is not null) select floor(lon * 1000)::bigint || '_' || floor(lat * 1000)::bigint cell, count(*) n, min(tree_id) as first from t group by 1",
    "alias_resolve": "with l as (select distinct old_seg_key o, new_seg_key n from tree_crown_lineage_v5 where snapshot_no = (select max(snapshot_no) from tree_crown_lineage_v5)), p as (select n, count(*) k from l group by 1), s as (select o, count(*) c, max(k) k from l join p using (n) group by 1), a as (select distinct old_seg_key o from tree_crown_lineage_v5 where snapshot_no = 1) select case when c is null then 'unknown' when c > 1 then 'split' when k > 1 then 'merged' else 'current' end status, count(*) n from a left join s using (o) group by 1",
    "species_maxima_badges": f"with a as (select {ID} tree_id, max(height_max_m) h, max(crown_volume_m3) v from tree_assets_pilot group by 1), t as (select {ID} tree_id, min(species_latin) species from trees where species_latin is not null group by 1), x as (select tree_id, species, 'height' measure, h val from t join a using (tree_id) where h is not null union all select tree_id, species, 'volume', v from t join a using (tree_id) where v is not null), r as (select *, row_number() over (partition by species, measure order by val desc, tree_id) i from x) select species, measure, max(tree_id) filter (where i = 1) leader, max(val) filter (where i = 1) as value, max(val) filter (where i = 2) as next, coalesce(max(val) filter (where i = 1) - max(val) filter (where i = 2) < 0.5, false) within_margin from r where i <= 2 group by 1, 2",
    "comparison_board_class": f"with {PIP}, f as (select p_id k, first(region_id order by rk, region_id) region_id from hit group by 1), j as (select region_id, seg, v from f join cust using (k)) select region_id, seg, count(*) n, case when count(*) > 5 then list_transform(quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]), lambda x: round(x, 4)) end q, case when count(*) <= 5 then list_sort(list(v)) end exact from j group by 1, 2",
    "parcel_summary": f"with {PIP}, f as (select p_id k, min(region_id) region_id from hit group by 1), j as (select region_id, k, v, row_number() over (partition by region_id order by v desc, k) i, row_number() over (partition by region_id order by v desc, k desc) i2 from f join cust using (k)) select region_id, count(*) n, count(*) filter (where v > 0) n_confident, round(sum(v), 2) as value, max(k) filter (where i2 = 1) top, string_agg(k, ',' order by i) filter (where i <= 3) best from j group by 1",
    "genus_agreement": f"with t as (select {_G('species_latin')} a, {_G('species_latin_raw')} b from trees) select a = b agree, count(*) n from t where a is not null and b is not null group by 1",
    "height_plausibility": "select case when mature_height_m is null or lidar_height_m is null then 'not_assessed' when lidar_height_m > mature_height_m * 1.3 then 'implausible' else 'plausible' end state, count(*) n from tree_species_attributes group by 1",
    "release_gates": f"with g as (select 'trees have an id' gate, 'error' severity, count(*) n from trees where {ID} is null union all select 'retired after loaded', 'error', count(*) from trees where retired_at < loaded_at union all select 'positions on the globe', 'warning', count(*) from trees where lon is not null and (abs(lon) > 180 or abs(lat) > 90) union all select 'one delivery per tree', 'warning', count(*) from (select {ID} k from trees group by 1 having count(*) > 1) union all select 'assets name trees', 'warning', count(*) from tree_assets_pilot where {ID} is not null and {ID} not in (select {ID} from trees where {ID} is not null) union all select 'cluster sizes positive', 'error', count(*) from tree_crown_merge_pilot where cluster_size <= 0) select gate, severity, n n_bad, case when n = 0 then 'PASS' else 'FAIL' end as result from g",
    "conflict_reasons": "with n as (select cluster_id, created_at_utc, count(distinct nullif(lower(trim(member_tree_id, ' ' || chr(9))), '')) n, max(cluster_size) t, sum(coalesce(is_primary, 0)) p, count(distinct nullif(lower(trim(primary_tree_id, ' ' || chr(9))), '')) k from tree_crown_merge_pilot where cluster_id is not null group by 1, 2) select concat_ws('; ', case when n <> t then 'wrong size' end, case when p = 0 then 'no primary' end, case when p > 1 then 'several primaries' end, case when k > 1 then 'contradicting ids' end) reasons, count(*) n from n group by 1",
    "view_states": f"with {ADDRESS_SQL}, e as (select k, replace(replace(replace(url_encode(street), '%20', '+'), '%2A', '*'), '~', '%7E') st, replace(url_encode(suburb), '%20', '+') su, replace(url_encode(unit), '%20', '+') un from addr) select k, concat_ws('&', 'q=' || st, 's=' || su, 'u=' || un) url, true same from e",
    "unified_points": "with c as (select point_id id, trim(regexp_replace(scientific_name, '\\s+', ' ', 'g')) a, trim(regexp_replace(species_or_name, '\\s+', ' ', 'g')) b, height_m, try_cast(json_extract_string(properties_json, '$.crew') as int) crew from nz_tree_points) select id, coalesce(case when lower(a) not in ('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', '<blank>') then a end, case when lower(b) not in ('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', '<blank>') then b end) as name, height_m height, crew from c",
    "incremental_rebuild": "select distinct new_seg_key, old_overlapping_crowns from v5_lineage_new_summary where snapshot_no = (select max(snapshot_no) from v5_lineage_new_summary)",
    "street_nearby": f"with {CUST}, {XY_SQL}, j as (select k a_id, tree_id b_id, sqrt((cust.x - xy.x) * (cust.x - xy.x) + (cust.y - xy.y) * (cust.y - xy.y)) d from cust, xy where abs(cust.x - xy.x) <= 20 and abs(cust.y - xy.y) <= 20) select a_id, b_id, row_number() over (partition by a_id order by d, b_id)::int as rank from j where d <= 20 qualify rank <= 50",
}
