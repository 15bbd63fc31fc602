"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.canon import canonical_entries, entries_within, unmatched_texts
from grovekit.llm.leakage import leaked_items
from grovekit.llm.linkage import link_patterns, link_points
from grovekit.llm.linkrows import merge_groups
from grovekit.llm.mixing import mix
from grovekit.llm.splitting import split_documents
from grovekit.llm.survivors import fuse, instant, record_claims, record_votes
from grovekit.session import bounded_collect, cut, plain_id, table

FIELDS = ["species_latin", "species_common", "owner_class", "notable_point_name"]


def _rank(ranks: list, field: str, c):
    """Trust rank of a value; values not listed, and nulls, come last."""
    out = F.lit(2**31 - 1)
    for r in ranks:
        if r["field_name"] == field:
            out = F.when(c == r["field_value"], F.lit(r["trust_rank"])).otherwise(out)
    return out


def _claims(spark: SparkSession, d: str) -> DataFrame:
    ranks = bounded_collect(table(spark, d, "trust_ranks"), 1_000, "trust ranks")
    rows = table(spark, d, "trees").select(
        plain_id("tree_id").alias("tree_id"),
        *FIELDS,
        F.col("source_primary").alias("source"),
        _rank(ranks, "source_primary", F.col("source_primary")).alias("r_source"),
        _rank(ranks, "species_confidence", F.col("species_confidence")).alias("r_conf"),
        instant(F.col("as_of_utc")).alias("seen"),
    )
    return record_claims(rows, FIELDS, [F.col(c) for c in ("source", "r_source", "r_conf", "seen")])


def _fused(spark: SparkSession, d: str) -> DataFrame:
    late = F.coalesce(-F.unix_micros("seen"), F.lit(2**63 - 1))
    return fuse(record_votes(_claims(spark, d), merge_groups(spark, d), [F.col("r_source"), F.col("r_conf"), late]))[0]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("group_tree_id", "field_name", "tree_id")


def p1_fused(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often the most probable value is that of the record which precedence puts first."""
    same = (F.col("value") == F.col("record_value")).cast("double")
    return _fused(spark, d).groupBy("field_name").agg(F.count("*").alias("n_cases"), F.avg(same).alias("agree"), F.avg("posterior").alias("posterior"), F.avg("record_posterior").alias("record_posterior"))


def _taxa(spark: SparkSession, d: str) -> DataFrame:
    return canonical_entries(table(spark, d, "trees"), plain_id("tree_id"), ["species_latin_raw", "species_common_raw"], table(spark, d, "itree_species_ref"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _taxa(spark, d).select(F.col("key").alias("tree_id"), F.col("entry").alias("taxon_id"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_texts(table(spark, d, "trees"), cut(_taxa(spark, d)), ["species_latin_raw", "species_common_raw"])


def p3_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trees").select(F.explode(F.array("species_latin_raw", "species_common_raw")).alias("t"))
    return entries_within(t, F.col("t"), table(spark, d, "itree_species_ref")).withColumnRenamed("entry", "taxon_id")


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return link_points(table(spark, d, "nz_tree_points"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_links(spark, d).select("point_id_a", "point_id_b")


def p5_patterns(spark: SparkSession, d: str) -> DataFrame:
    return link_patterns(table(spark, d, "nz_tree_points"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_groups(spark, d)


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where("piece_no = 0").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_fused": p1_fused,
    "p1_agreement": p1_agreement,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p3_candidates": p3_candidates,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p5_patterns": p5_patterns,
    "p6_found": p6_found,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
}

_PLAIN = "nullif(lower(trim({}, ' ' || chr(9))), '')"
_P6 = f"""
with recursive rows_ as (select {_PLAIN.format('primary_tree_id')} p, {_PLAIN.format('member_tree_id')} m,
  case when cluster_id is not null and created_at_utc is not null then '#' || cast(created_at_utc as varchar) || '#' || cluster_id end c from tree_crown_merge_pilot),
e as (select p a, m b from rows_ where c is null union select c, p from rows_ where c is not null union select c, m from rows_ where c is not null),
f as (select a, b from e where a is not null and b is not null and a <> b), g as (select a, b from f union select b, a from f),
r(v, w) as (select a, a from g union select r.v, g.b from r join g on r.w = g.a),
h as (select v, min(w) w, count(*) n from r where v not like '#%' and w not like '#%' group by v)
select v tree_id, w group_tree_id from h where n > 1"""
_MISSING = "('', '-', '?', 'n/a', 'na', 'nil', 'none', 'null', 'not recorded', 'tba', 'tbc', 'unidentified', 'unk', 'unknown', '<blank>')"
_P1 = f"""
with g as ({_P6}), t as (select {_PLAIN.format('tree_id')} tree_id, source_primary s, species_confidence c, try_cast(as_of_utc as timestamptz) a,
  unnest(['species_latin', 'species_common', 'owner_class', 'notable_point_name']) field_name, unnest([species_latin, species_common, owner_class, notable_point_name]) v from trees),
u as (select group_tree_id, t.field_name, tree_id, coalesce(x.trust_rank, 2147483647) rs, coalesce(y.trust_rank, 2147483647) rc, a from t join g using (tree_id)
  left join trust_ranks x on x.field_name = 'source_primary' and x.field_value = s left join trust_ranks y on y.field_name = 'species_confidence' and y.field_value = c
  where lower(trim(v, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) not in {_MISSING})
select group_tree_id, field_name, tree_id from u qualify row_number() over (partition by group_tree_id, field_name order by rs, rc, a desc nulls last, tree_id) = 1"""
_FOLD = "array_to_string(regexp_extract_all(lower(strip_accents(replace({}, '×', ' x '))), '[a-z0-9]+'), ' ')"
_DOUBLE = "replace(replace(replace(replace(replace(lower(n), 'ā', 'aa'), 'ē', 'ee'), 'ī', 'ii'), 'ō', 'oo'), 'ū', 'uu')"
_P3_CANDIDATES = f"""
with t as (select distinct unnest([species_latin_raw, species_common_raw]) t from trees), q as (select t, {_FOLD.format('t')} k from t where trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''),
r as (select taxon_id, scientific_name n, true latin, true short from itree_species_ref where taxon_rank is distinct from 'genus' union all select taxon_id, common_name, false, false from itree_species_ref where taxon_rank is distinct from 'genus'
  union all select taxon_id, unnest(string_split(other_names, ';')), true, false from itree_species_ref where taxon_rank is distinct from 'genus'),
s as (select taxon_id, {_FOLD.format('n')} w, latin, short from r where n is not null union select taxon_id, {_FOLD.format(_DOUBLE)}, latin, short from r where n is not null),
a as (select taxon_id, w from s where w <> '' union select taxon_id, regexp_replace(w, '^(.*) ([^ ]+)$', '\\2 \\1') from s where w like '% %'
  union select taxon_id, substr(w, 1, 1) || substr(w, strpos(w, ' ')) from s where w like '% %' and (short or (latin and w not like '% % %'))),
j as (select t, taxon_id, levenshtein(k, w) d from q join a on abs(length(k) - length(w)) <= 3 and levenshtein(k, w) <= case when length(k) < 5 then 0 when length(k) < 8 then 1 when length(k) < 16 then 2 else 3 end)
select t as text, taxon_id, min(d)::int distance from j group by 1, 2"""
_NOTHING = "('unknown', 'unidentified', 'none', 'nil', 'null', 'na', 'tba', 'tbc', 'not', 'tree', 'other', 'various', 'mixed', 'exotic', 'native')"
_NO_EPITHET = "('sp', 'spp', 'species', 'indet', 'unknown', 'unclear', 'hybrid', 'hort', 'cultivar')"
_WORD = "({0}.{2} = {1}.{2} or levenshtein({0}.{2}, {1}.{2}) <= case when least(length({0}.{2}), length({1}.{2})) >= 12 then 3 + {3} when least(length({0}.{2}), length({1}.{2})) >= 6 then 2 + {3} else 1 end)"
_GENUS = "case when length(a.g) = 1 or length(b.g) = 1 then substr(a.g, 1, 1) = substr(b.g, 1, 1) else {} end"
_P5 = f"""
with n as (select point_id id, source_slug s, lon x0, lat y0, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(scientific_name)), '''[^'']*''|"[^"]*"|\\([^)]*\\)|×', ' ', 'g'),
  '^\\s*([a-z]{{4,}})\\s*,\\s*([a-z]+)\\b', '\\2 \\1'), '[^a-z]+', ' ', 'g')) t from nz_tree_points where point_id is not null and source_slug is not null),
m as (select *, replace(regexp_replace(t, '^((prob|poss|cf|aff|nr|probably|possibly|maybe) )+', ''), ' x ', ' ') u from n),
w as (select *, split_part(u, ' ', 1) a, split_part(u, ' ', 2) b, coalesce(u not in ('n a', 'not recorded') and split_part(u, ' ', 1) not in {_NOTHING} and u <> '', false) k from m),
p as (select id, s, case when k then a end g, case when k and length(b) >= 3 and b not in {_NO_EPITHET} then b end e,
  case when x0 between 160 and 180 and y0 between -55 and -25 then x0 when y0 between 160 and 180 and x0 between -55 and -25 then y0 when x0 between 160 and 180 and y0 between 25 and 55 then x0 end x,
  case when x0 between 160 and 180 and y0 between -55 and -25 then y0 when y0 between 160 and 180 and x0 between -55 and -25 then x0 when x0 between 160 and 180 and y0 between 25 and 55 then -y0 end y from w),
c as (select distinct * from p where x is not null),
j as (select a.id point_id_a, b.id point_id_b, a.g ga, a.e ea, b.g gb, b.e eb,
  a.e is null or b.e is null or ({_WORD.format('a', 'b', 'e', 0)} and {_GENUS.format(_WORD.format('a', 'b', 'g', 0))}) or (a.e = b.e and {_GENUS.format(_WORD.format('a', 'b', 'g', 2))})
    or (a.g = b.g and length(a.g) > 1 and {_WORD.format('a', 'b', 'e', 2)}) fits
  from c a join c b on a.id < b.id and a.s <> b.s and abs(a.y - b.y) < 0.0001 and 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) < 5)
select distinct point_id_a, point_id_b from j where fits"""
SQL = {"p1_found": _P1, "p3_candidates": _P3_CANDIDATES, "p5_found": _P5, "p6_found": _P6}
