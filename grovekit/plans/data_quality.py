"""Queries of the general problems 2, 4 and 7 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.operators.proximity import near_points, points_in_regions
from grovekit.operators.references import orphan_references, orphan_report
from grovekit.operators.snapshots import lineage_changes
from grovekit.plans.spatial import CUST, customers, regions
from grovekit.session import plain_id, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lineage_changes(table(spark, d, "tree_crown_lineage_v5"), table(spark, d, "v5_lineage_new_summary"), plain_id)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("table_name", "snapshot_no", "change_kind").agg(F.count("*").alias("n_keys"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ["tree_root_zone_pilot", "tree_assets_pilot", "tree_species_attributes"]
    children = {n: (table(spark, d, n), plain_id("tree_id"), F.col("created_at_utc")) for n in names}
    return orphan_references(children, table(spark, d, "trees"), plain_id("tree_id"), F.col("loaded_at"), F.col("retired_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", F.col("key").alias("tree_id"), F.col("period").alias("created_month"), "kind")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).withColumn("distance_m", F.round("distance_m", 6))


def _near(spark: SparkSession, d: str) -> DataFrame:
    return near_points(table(spark, d, "tree_low_canopy_candidates"), F.col("candidate_id"), table(spark, d, "trees"), plain_id("tree_id"), 5.0)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select(F.col("centre_id").alias("candidate_id"), F.col("other_id").alias("tree_id"))


def p7_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions that hold each point, their borders included, holes left out."""
    return points_in_regions(customers(spark, d), "k", "x", "y", regions(spark, d), "rid", "rings").select(F.col("k").alias("p_id"), F.col("rid").alias("region_id"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found, "p4_report": p4_report, "p7_found": p7_found, "p7_near": p7_near, "p7_regions": p7_regions}

PLAIN = "nullif(lower(trim({}, ' ' || chr(9))), '')"

_P2 = f"""
with a as (select snapshot_no s, old_seg_key k1, new_seg_key k2, min({PLAIN.format('old_tree_id')}) t,
  min(intersection_m2) v1, min(old_fraction) v2, min(new_fraction) v3 from tree_crown_lineage_v5 where snapshot_no is not null group by 1,2,3),
n as (select s, lag(s) over (order by s) p from (select distinct s from a)),
x as (select n.s, a.* exclude s from a join n on a.s = n.s where n.p is not null), y as (select n.s, a.* exclude s from a join n on a.s = n.p),
b as (select snapshot_no s, new_seg_key k2, min(old_overlapping_crowns) v1 from v5_lineage_new_summary where snapshot_no is not null group by 1,2),
m as (select s, lag(s) over (order by s) p from (select distinct s from b)),
z as (select m.s, b.* exclude s from b join m on b.s = m.s where m.p is not null), w as (select m.s, b.* exclude s from b join m on b.s = m.p)
select 'tree_crown_lineage_v5' table_name, coalesce(x.s, y.s) snapshot_no, coalesce(x.k1, y.k1) old_seg_key, coalesce(x.k2, y.k2) new_seg_key,
  case when y.s is null then 'added' when x.s is null then 'removed' else 'changed' end change_kind
from x full join y on x.s = y.s and x.k1 is not distinct from y.k1 and x.k2 is not distinct from y.k2
where x.s is null or y.s is null or x.t is distinct from y.t or (x.v1 is null) <> (y.v1 is null) or (x.v2 is null) <> (y.v2 is null) or (x.v3 is null) <> (y.v3 is null)
  or coalesce(abs(x.v1 - y.v1) >= 1e-6, false) or coalesce(abs(x.v2 - y.v2) >= 1e-6, false) or coalesce(abs(x.v3 - y.v3) >= 1e-6, false)
union all
select 'v5_lineage_new_summary', coalesce(z.s, w.s), '', coalesce(z.k2, w.k2),
  case when w.s is null then 'added' when z.s is null then 'removed' else 'changed' end
from z full join w on z.s = w.s and z.k2 is not distinct from w.k2
where z.s is null or w.s is null or z.v1 is distinct from w.v1"""

_LIVES = f"lives as (select {PLAIN.format('tree_id')} k, min(loaded_at) born, min(retired_at) died from trees group by 1)"
_REFS = " union all ".join(
    f"select '{t}' table_name, {PLAIN.format('tree_id')} k, created_at_utc c from {t}" for t in ("tree_root_zone_pilot", "tree_assets_pilot", "tree_species_attributes")
)
_P4 = f"""
with {_LIVES}, refs as ({_REFS}), j as (
  select table_name, r.k, strftime(c, '%Y-%m') m, c, born, died, l.k is null gone from refs r left join lives l on r.k = l.k where r.k is not null)
select distinct table_name, k tree_id, m created_month, 'missing' kind from j where gone
union select distinct table_name, k, m, 'late' from j where c < born
union select distinct table_name, k, m, 'deleted' from j where c >= died"""
_P4_REPORT = f"""
with {_LIVES}, refs as ({_REFS}), g as (
  select table_name, r.k, strftime(c, '%Y-%m') m, count(*) n, min(c) lo, max(c) hi from refs r where r.k is not null group by 1,2,3),
j as (select g.*, born, died, l.k is null gone from g left join lives l on g.k = l.k),
u as (select table_name, m, n, 'missing' kind from j where gone union all select table_name, m, n, 'late' from j where lo < born
  union all select table_name, m, n, 'deleted' from j where hi >= died)
select table_name, m period, kind, count(*) n_keys, cast(sum(n) as bigint) n_references from u group by 1,2,3"""

_NEAR = f"""
with ok as (select distinct candidate_id, lon, lat from tree_low_canopy_candidates where candidate_id is not null and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)),
t as (select distinct {PLAIN.format('tree_id')} tree_id, lon, lat from trees where tree_id is not null and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)),
p as (select ok.candidate_id, t.tree_id, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(t.lat - ok.lat) / 2), 2)
  + cos(radians(ok.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - ok.lon) / 2), 2)))) dist
  from ok join t on abs(t.lat - ok.lat) < 0.00005 and abs(t.lon - ok.lon) < 0.0002)
"""

SQL = {
    "p2_found": _P2,
    "p2_counts": f"with f as ({_P2}) select table_name, snapshot_no, change_kind, count(*) n_keys from f group by 1,2,3",
    "p4_found": _P4,
    "p4_report": _P4_REPORT,
    "p7_found": _NEAR + "select distinct candidate_id, tree_id from p where dist <= 5",
    "p7_regions": f"""with {CUST}, reg as (select n_nationkey rid, (n_nationkey % 5) * 400.0 x0, (n_nationkey // 5) * 400.0 y0 from nation)
select k p_id, rid region_id from cust, reg where x >= x0 and y >= y0 and x - x0 + y - y0 <= 500 and not (x - x0 between 50 and 100 and y - y0 between 50 and 100)""",
    "p7_near": _NEAR + "select candidate_id centre_id, tree_id other_id, round(min(dist), 6) distance_m from p where dist <= 5 group by 1, 2",
}
