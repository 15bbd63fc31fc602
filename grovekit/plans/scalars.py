"""Queries of the scalar functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import geo, growth, ids, text
from grovekit.operators.publish import search_pairs
from grovekit.session import plain_id, table

c = F.col
UNKNOWN_SQL = "('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', '<blank>')"


def clean_sql(x: str) -> str:
    return f"case when lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))) in {UNKNOWN_SQL} then null else trim(regexp_replace({x}, '\\s+', ' ', 'g')) end"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def trees(s, d):
    return table(s, d, "trees").select("*", plain_id("tree_id").alias("id"))


ID = "nullif(lower(trim(tree_id, ' ' || chr(9))), '')"


def text_clean(s: SparkSession, d: str) -> DataFrame:
    return trees(s, d).select("id", *[text.clean_text(c(k)).alias(k) for k in ("species_common_raw", "species_latin_raw", "owner_raw")]).distinct()


def species_confidence_class(s, d):
    return trees(s, d).select("id", text.species_confidence(c("species_common_raw"), c("species_latin_raw")).alias("scope")).distinct()


def owner_aliases(s, d):
    known = {"PARKS DEPT.": "Parks", "parks": "Parks", "roads": "Roads", "Priv.": "Private"}
    return trees(s, d).groupBy(text.aliased(c("owner_raw"), known).alias("owner")).agg(F.count("*").alias("n"))


def name_compatibility(s, d):
    t = trees(s, d)
    return t.select("id", text.names_compatible(c("species_common"), c("species_latin"), c("species_common_raw")).alias("compatible"), F.size(text.name_tokens(c("species_common_raw"))).alias("n_tokens")).distinct()


def match_classes(s, d):
    t = trees(s, d)
    cls = text.match_confidence(c("notable_point_distance_m"), c("notable_point_type") == "1", c("notable_point_name_compatible") == 1)
    return t.groupBy(cls.alias("match_class")).agg(F.count("*").alias("n"))


def flag_labels(s, d):
    t = trees(s, d)
    label = text.flag_label("Tree", [(c("is_protected_notable") == 1, F.lit("protected")), (c("notable_group_match") == 1, F.lit("group")), (c("notable_point_review_required") == 1, F.concat(F.lit("review:"), F.coalesce(c("notable_point_type"), F.lit("-"))))])
    return t.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def growth_class_of_names(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", growth.growth_class(c("p_name"), c("p_type")).alias("class"))


def taxon_normalise(s, d):
    t = table(s, d, "nz_tree_points")
    x = text.taxon_parts(c("scientific_name"))
    return t.select("point_id", x["genus"].alias("genus"), x["species"].alias("species"), x["scope"].alias("scope"))


def taxon_keys(s, d):
    t = table(s, d, "nz_tree_points")
    return t.select("point_id", text.taxon_key(c("scientific_name")).alias("taxon"), text.genus_of(c("scientific_name")).alias("genus"))


def display_names(s, d):
    x = text.display_name(c("scientific_name"))
    return table(s, d, "nz_tree_points").select("point_id", x["name"].alias("name"), x["cultivar"].alias("cultivar"), x["several"].alias("several"))


def _address(s, d):
    # an address list derived from the customers: number/unit and a street of the part names
    k = c("c_custkey")
    kinds = F.array(*[F.lit(x) for x in ("Ave", "St", "rd", "Pl", "Tce", "Way", "Cres")])
    heads = F.array(*[F.lit(x) for x in ("St", "Mt", "Pt", "Old", "Ōtara", "O'Neill")])
    street = F.concat_ws(" ", F.get(heads, (k % 6).cast("int")), F.concat(F.lit("Nation"), c("c_nationkey").cast("string")), F.get(kinds, (k % 7).cast("int")))
    number = F.when(k % 5 == 0, F.concat((k % 9 + 1).cast("string"), F.lit("/"), (k % 250 + 1).cast("string"), F.lit("a"))).otherwise((k % 250 + 1).cast("string"))
    return table(s, d, "customer").select(k.alias("k"), number.alias("number"), F.when(k % 11 == 0, F.lit("Flat 3")).alias("unit"), street.alias("street"), c("c_mktsegment").alias("suburb"))


ADDRESS_SQL = """addr as (select c_custkey k, case when c_custkey % 5 = 0 then (c_custkey % 9 + 1)::varchar || '/' || (c_custkey % 250 + 1)::varchar || 'a' else (c_custkey % 250 + 1)::varchar end number,
  case when c_custkey % 11 = 0 then 'Flat 3' end unit, (['St','Mt','Pt','Old','Ōtara','O''Neill'])[c_custkey % 6 + 1] || ' Nation' || c_nationkey || ' ' || (['Ave','St','rd','Pl','Tce','Way','Cres'])[c_custkey % 7 + 1] street, c_mktsegment suburb from customer)"""
STREET_SQL = """replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(street)), '[’''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '^st ', 'saint '), '^mt ', 'mount '), '^pt ', 'point ') || '$', ' ave$', ' avenue$'), ' st$', ' street$'), ' rd$', ' road$'), ' pl$', ' place$'), ' tce$', ' terrace$'), ' cres$', ' crescent$')"""


def street_normalise(s, d):
    a = _address(s, d)
    n = text.norm_street(c("street"))
    return a.select("k", n.alias("street_norm"), text.prefix_key(n).alias("shard"))


def unit_number_split(s, d):
    x = text.split_number(c("number"), c("unit"))
    return _address(s, d).select("k", x["number"].alias("number"), x["unit"].alias("unit"))


def number_parse(s, d):
    return trees(s, d).select("id", text.number_of(c("source_tree_id")).alias("v")).distinct()


def address_query_parse(s, d):
    q = F.concat(F.when(c("unit").isNotNull(), F.lit("Unit 7, ")).otherwise(""), c("number"), F.lit(" "), c("street"), F.lit(", "), c("suburb"))
    x = text.address_query(q)
    return _address(s, d).select("k", *[x[f].alias(f) for f in ("unit", "number", "street", "suburb")])


def stem_sizes(s, d):
    a = table(s, d, "tree_assets_pilot")
    cls = growth.keyword_class(c("growth_setting"), [("conifer", ["forest"], []), ("palm_other", ["stand"], [])], "evergreen_broadleaf")
    a = a.withColumn("cls", cls).withColumn("diam", growth.circle_diameter(c("crown_volume_m3")))
    x = growth.dbh_from_crown(c("height_max_m"), c("diam"), c("cls"))
    a = a.select(plain_id("tree_id").alias("tree_id"), "created_at_utc", "height_max_m", "crown_volume_m3", "cls", x["confidence"].alias("conf"), F.round(x["dbh_cm"], 6).alias("dbh"), F.round(growth.dbh_from_height(c("height_max_m"), c("cls")), 6).alias("dbh_h"))
    return a.groupBy("cls", "conf").agg(F.count("*").alias("n"), F.round(F.sum("dbh"), 3).alias("dbh"), F.round(F.sum("dbh_h"), 3).alias("dbh_h"))


def carbon_by_class(s, d):
    """Flagship: class by keywords, size, biomass and runoff per class with an uncertainty band."""
    li, pa = table(s, d, "lineitem"), table(s, d, "part")
    j = li.select("l_partkey", "l_quantity", "l_extendedprice", "l_discount").join(pa.select("p_partkey", "p_name", "p_type"), c("l_partkey") == c("p_partkey"))
    j = j.select(growth.growth_class(c("p_name"), c("p_type")).alias("class"), c("l_quantity").alias("h"), (c("l_extendedprice") / 1000).alias("area"), (F.abs("l_discount") * 10).alias("sealed"))
    x, w = growth.carbon(c("h"), c("class")), growth.runoff(c("area"), c("class"), c("sealed"))
    g = j.groupBy("class").agg(F.count("*").alias("n"), F.sum(x["above_kg"]).alias("a"), F.sum(x["co2_t"]).alias("c"), F.sum(w["avoided_m3"]).alias("r"), F.sum(growth.particles_kg(c("area"), c("class"))).alias("p"))
    return g.select("class", "n", F.round("a", 2).alias("above_kg"), F.round("c", 4).alias("co2_t"), F.round("r", 4).alias("avoided_m3"), F.round("p", 4).alias("particles_kg"), F.round(c("c") * 0.7, 4).alias("co2_low"), F.round(c("c") * 1.3, 4).alias("co2_high"))


CLS = """case when lower(t) ~ 'phoenix|cordyline|rhopalostylis|washingtonia|trachycarpus|howea|butia|areca|cycas|livistona|nikau|ti kouka|cabbage tree|cycad' or regexp_matches(lower(t), '\\bpalm\\b') then 'palm_other'
 when regexp_matches(lower(t), 'pine|fir|spruce|cedar|podocarp|rimu|totara|matai|miro|kahikatea|kauri|yew|cypress|macrocarpa|redwood|araucaria') then 'conifer'
 when regexp_matches(lower(t), 'oak|plane|maple|elm|ash|beech|birch|willow|poplar|liquidambar|magnolia|ginkgo|cherry|apple|pear|robinia|alder|tulip|walnut|horse chestnut|wisteria|rowan|hawthorn') then 'deciduous_broadleaf'
 else 'evergreen_broadleaf' end""".replace("lower(t) ~ '", "regexp_matches(lower(t), '").replace("cycad' or", "cycad') or")


def life_stages(s, d):
    a = table(s, d, "lineitem").select(c("l_quantity").alias("h"), (c("l_extendedprice") / 1000).alias("area"), F.when(c("l_returnflag") == "A", "conifer").when(c("l_returnflag") == "N", "palm_other").otherwise("deciduous_broadleaf").alias("cls"))
    y = growth.regrowth_years(c("area"), c("cls"))
    a = a.select("cls", growth.life_stage(c("h"), c("cls")).alias("stage"), growth.replaceability(y, c("h")).alias("replaceability"), growth.size_percent(c("h"), c("cls")).alias("pct"), growth.banded(c("h"), [(5, "under 5"), (10, "5-10"), (20, "10-20")], "20+").alias("band"))
    return a.groupBy("cls", "stage", "replaceability", "band").agg(F.count("*").alias("n"), F.round(F.sum("pct"), 3).alias("pct"))


def fnv_bucket(s, d):
    t = trees(s, d).select("id").distinct()
    return t.select("id", ids.fnv1a(c("id")).alias("h"), (ids.fnv1a(c("id")) % 4096).alias("bucket"))


def stable_ids(s, d):
    t = table(s, d, "orders")
    k = c("o_orderkey")
    x = {2013: F.when(k % 3 != 0, (k % 1000) / 4), 2016: F.when(k % 2 == 0, (k % 777) / 4), 2024: (k % 555) / 4}
    y = {n: v * 2 for n, v in x.items()}
    return t.select("o_orderkey", ids.sha_id("traj_", ids.observation_token([2013, 2016, 2024], x, y)).alias("sid"), ids.sha_id("tree_", F.concat(F.lit("canonical:"), k.cast("string"))).alias("cid"))


def spatial_folds(s, d):
    t = trees(s, d).select("id", "approx_x_m", "approx_y_m").where("approx_x_m is not null and approx_y_m is not null").distinct()
    return t.select("id", ids.block_fold(c("approx_x_m"), c("approx_y_m"), 200.0).alias("fold"), ids.near_block_edge(c("approx_x_m"), c("approx_y_m"), 200.0, 15.0).alias("edge"), F.concat_ws("_", F.floor(c("approx_x_m") / 200).cast("string"), F.floor(c("approx_y_m") / 200).cast("string")).alias("block"))


def _numbers(s, d):
    k = c("c_custkey")
    digits = [F.substr(F.lit(ids.ALPHABET), ((k * 7919 + i * 131) % (32 - i) + 1).cast("int"), F.lit(1)) for i in range(6)]
    return table(s, d, "customer").select(k.alias("k"), F.concat(*digits).alias("payload"))


_PAYLOAD = " || ".join(f"substr('{ids.ALPHABET}', ((c_custkey * 7919 + {i * 131}) % {32 - i} + 1)::int, 1)" for i in range(6))
_V = f"(instr('{ids.ALPHABET}', substr({{s}}, {{i}}, 1)) - 1)"


def _luhn_sql(s: str, n: int, first: int) -> str:
    terms = []
    for j in range(n):
        f = first if j % 2 == 0 else 3 - first
        v = f"({f} * {_V.format(s=s, i=n - j)})"
        terms.append(f"({v} // 32 + {v} % 32)")
    return "((" + " + ".join(terms) + ") % 32)"


def check_numbers(s, d):
    n = _numbers(s, d).withColumn("check", ids.check_char(c("payload"))).withColumn("number", F.concat(F.lit("T"), c("payload"), c("check")))
    wrong = F.concat(F.lit("t-"), F.substring("payload", 1, 3), F.lit(" "), F.substring("payload", 4, 3), F.lit("0"))
    return n.select("k", "number", ids.valid_number(c("number")).alias("ok"), ids.valid_number(ids.number_text(wrong)).alias("typed_ok"))


def near_number_candidates(s, d):
    n = _numbers(s, d).withColumn("number", ids.number_text(F.concat(F.lit("T"), c("payload"), F.lit("7"))))
    return n.select("k", F.explode(ids.near_numbers(c("number"))).alias("near"))


def key_kinds(s, d):
    t = trees(s, d).select(c("id").alias("key")).unionAll(table(s, d, "tree_crown_lineage_v5").select("new_seg_key")).unionAll(_numbers(s, d).select(F.concat(F.lit("T"), "payload", ids.check_char(c("payload")))))
    return t.groupBy(ids.key_kind(c("key"), "akl_").alias("kind")).agg(F.count("*").alias("n"))


def significant_figures(s, d):
    o = table(s, d, "orders").select("o_totalprice")
    return o.select(text.significant(c("o_totalprice"), 3).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


def fuzzy_scores(s, d):
    r = table(s, d, "itree_species_ref").where("common_name is not null").select("taxon_id", "common_name")
    t = trees(s, d).select(c("species_common_raw").alias("typed")).where("typed is not null").distinct()
    t = t.select("typed", text.search_query(c("typed"))["tokens"].alias("q"))
    hit = search_pairs(t, "typed", "q", r, "taxon_id", "common_name")
    return hit.select(c("query").alias("typed"), c("item_id").alias("taxon_id"), text.phrase_score(c("tokens"), c("label")).alias("score")).where("score >= 45")


def one_edit_apart(s, d):
    p = table(s, d, "part").select(F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b")).distinct()
    return p.select("a", "b", text.one_edit(c("a"), F.concat(F.substr(c("a"), F.lit(2), F.lit(1)), F.substr(c("a"), F.lit(1), F.lit(1)), F.substr(c("a"), F.lit(3)))).alias("swap"), text.one_edit(c("a"), c("b")).alias("near"), text.one_edit(c("a"), F.concat(c("a"), F.lit("x"))).alias("longer"))


def height_phrases(s, d):
    k = c("o_orderkey")
    w = F.get(F.array(*[F.lit(x) for x in ("taller than {}", "over {} m", "{} m or more", "height {}+", "at least {} metres", "{}+", "about {}")]), (k % 7).cast("int"))
    return table(s, d, "orders").select("o_orderkey", text.height_phrase(F.replace(w, F.lit("{}"), (k % 90).cast("string"))).alias("least"))


def circle_sizes(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", F.round(growth.circle_diameter(c("p_retailprice")), 6).alias("diameter"), F.round(growth.suppression_radius(c("p_size") * 1.0), 6).alias("r"), F.round(growth.suppression_radius(c("p_size") * 1.0, 1.5, 0.15, 2.0, 6.0), 6).alias("r4"), F.round(growth.size_llr(c("p_size") * 1.0, F.lit(25.0), F.lit(8.0)), 6).alias("llr"))


def sentence_flag_counts(s, d):
    pats = {"measured": "measured|height", "root": r"root plate|drip line", "wrong": "wrong name"}
    f = text.sentence_flags(c("text"), pats, r"\b(no|not|without)\b")
    return table(s, d, "documents").select("doc_id", F.array_join(f, ";").alias("flags"), text.looks_garbled(c("text")).alias("garbled"), F.coalesce(c("text").rlike(r"(?i)\bschool\b"), F.lit(False)).alias("school"))


def record_signatures(s, d):
    t = trees(s, d).where("notable_point_name is not null and lon is not null")
    return t.select("id", text.record_signature(c("notable_point_name"), c("notable_point_type"), c("lon"), c("lat")).alias("sig")).distinct()


def pixel_indices(s, d):
    l = table(s, d, "lineitem").select(c("l_quantity").alias("r"), (c("l_extendedprice") % 256).alias("g"), (F.abs("l_discount") * 1000 % 256).alias("b")).distinct()
    h = growth.hue_saturation(c("r"), c("g"), c("b"))
    return l.select("r", "g", "b", F.round(growth.green_leaf_index(c("r"), c("g"), c("b")), 6).alias("gli"), F.round(growth.difference_index(c("g"), c("r")), 6).alias("nd"), F.round(h["hue"], 4).alias("hue"), F.round(h["saturation"], 6).alias("sat"))


def epoch_years(s, d):
    o = table(s, d, "orders").select(F.unix_millis(c("o_orderdate").cast("timestamp")).alias("ms"), "o_orderpriority")
    tier = F.when(c("o_orderpriority").startswith("1"), "a").when(c("o_orderpriority").rlike("^[23]"), "b").otherwise("c")
    return o.groupBy(ids.epoch_ms_year(c("ms")).alias("y"), tier.alias("tier")).agg(F.count("*").alias("n"))


def export_values(s, d):
    l = table(s, d, "lineitem")
    z = lambda x: F.when(F.round(x, 3) != 0, F.round(x, 3))
    return l.groupBy(z(c("l_discount")).alias("disc"), z(c("l_tax")).alias("tax")).agg(F.count("*").alias("n"))


def slippy_tiles(s, d):
    t = trees(s, d).where("lon between 170 and 180 and lat between -50 and -30").select("id", "lon", "lat").distinct()
    x = ids.tile_xy(c("lon"), c("lat"), 16)
    k = ids.tile_corner(x["x"], x["y"], 16)
    return t.select("id", x["x"].alias("x"), x["y"].alias("y"), F.round(k["lon"], 6).alias("west"), F.round(k["lat"], 6).alias("north"))


def projected_points(s, d):
    t = table(s, d, "tree_low_canopy_candidates").where("lon is not null").select("candidate_id", "lon", "lat", "x_2193", "y_2193").distinct()
    g = geo.to_grid(c("lon"), c("lat"))
    t = t.select("*", g["x"].alias("x"), g["y"].alias("y"), geo.equirect(c("lon"), c("lat"), -37.0)["x"].alias("ex"))
    b = geo.from_grid(c("x"), c("y"))
    fits = (F.abs(c("x") - c("x_2193")) < 0.006) & (F.abs(c("y") - c("y_2193")) < 0.006)
    return t.select("candidate_id", fits.alias("fits"), F.round("ex", 3).alias("ex"), F.round(b["lon"], 7).alias("lon"), F.round(b["lat"], 7).alias("lat"))


def root_zones(s, d):
    r = table(s, d, "tree_root_zone_pilot").where("dbh_cm is not null and crown_radius_m is not null")
    x = growth.root_zone(c("dbh_cm"), c("crown_radius_m"), F.when(c("stability_radius_m") > 2, c("stability_radius_m") % 1))
    return r.select(x["flag"].alias("flag"), x["protection_m"].alias("p"), x["effective_area_m2"].alias("a")).groupBy("flag").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("protection_m"), F.round(F.sum("a"), 3).alias("area_m2"))


QUERIES = {f.__name__: f for f in (
    text_clean, species_confidence_class, owner_aliases, name_compatibility, match_classes, flag_labels, growth_class_of_names, taxon_normalise, taxon_keys,
    display_names, street_normalise, unit_number_split, number_parse, address_query_parse, stem_sizes, carbon_by_class, life_stages, fnv_bucket, stable_ids,
    spatial_folds, check_numbers, near_number_candidates, key_kinds, significant_figures, fuzzy_scores, one_edit_apart, height_phrases, circle_sizes,
    sentence_flag_counts, record_signatures, pixel_indices, epoch_years, export_values, slippy_tiles, projected_points, root_zones,
)}

_CLEAN3 = ", ".join(f"{clean_sql(k)} {k}" for k in ("species_common_raw", "species_latin_raw", "owner_raw"))
_TOK = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({x}), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w not in ('', 'a', 'and', 'mixed', 'native', 'of', 'the', 'tree', 'trees')))"
_PHR = "nullif(trim(regexp_replace(regexp_replace(replace(lower({x}), ' tree', ''), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"
_TAX = """tx as (select point_id, trim(regexp_replace(replace(scientific_name, '_', ' '), '\\s+', ' ', 'g'), ' .') t0 from nz_tree_points),
ty as (select point_id, t0, regexp_replace(regexp_replace(regexp_replace(t0, '(?i) (cf\\.|aff\\.).*$', ''), '(?i) (subsp\\.|ssp\\.|var\\.).*$', ''), ' [''"].*[''"]$', '') t from tx),
tz as (select point_id, t0, split_part(t, ' ', 1) a, split_part(t, ' ', 2) b, split_part(t, ' ', 3) e3 from ty),
tw as (select point_id, a, b, case when b in ('x', '×') then e3 else b end e, b in ('x', '×') hy, lower(t0) not in ('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', '<blank>', '-', '?') and regexp_full_match(a, '[A-Z][a-z]+') g, lower(b) in ('sp', 'sp.', 'spp', 'spp.') mk from tz)"""
_CO = f"(case class when 'conifer' then 1.5 * greatest(h, 0) + 0.02 * h * h when 'palm_other' then 2.0 + 1.2 * h else 1.6 * h + 0.04 * h * h end)"

SQL = {
    "text_clean": f"select distinct {ID} id, {_CLEAN3} from trees",
    "species_confidence_class": f"""with t as (select {ID} id, {clean_sql('species_common_raw')} k, {clean_sql('species_latin_raw')} l from trees)
select distinct id, case when k is null and l is null then 'unknown' when l is not null and (contains(lower(l), ' sp.') or contains(lower(l), ' spp.') or contains(lower(l), ' species')) then 'source_genus'
 when l is not null and len({words_sql('l')}) >= 2 then 'source_species' when l is not null then 'source_taxon' else 'source_common_only' end scope from t""",
    "owner_aliases": f"with t as (select {clean_sql('owner_raw')} o from trees) select case o when 'PARKS DEPT.' then 'Parks' when 'parks' then 'Parks' when 'roads' then 'Roads' when 'Priv.' then 'Private' else coalesce(o, 'Unknown') end as owner, count(*) n from t group by 1",
    "name_compatibility": f"""with t as (select {ID} id, {clean_sql('species_common')} a, {clean_sql('species_latin')} l, {clean_sql('species_common_raw')} b from trees),
u as (select id, l, {_PHR.format(x='a')} pa, {_PHR.format(x='b')} pb, coalesce({_TOK.format(x='a')}, []) ta, coalesce({_TOK.format(x='b')}, []) tb from t),
v as (select *, len(list_intersect(ta, tb)) m from u)
select distinct id, pb is not null and (coalesce(contains(pb, pa) or contains(pa, pb), false) or (len(ta) > 0 and len(tb) > 0 and ((least(len(ta), len(tb)) = 1 and m = len(ta)) or m >= 2))
  or coalesce(list_contains(string_split(pb, ' '), lower(split_part(l, ' ', 1))), false)) as "compatible", len(tb)::int n_tokens from v""",
    "match_classes": "select case when notable_point_distance_m is null then null when coalesce(notable_point_type <> '1', true) then 'unverified' when notable_point_name_compatible = 1 and notable_point_distance_m <= 1 then 'high' when notable_point_name_compatible = 1 and notable_point_distance_m <= 3 then 'medium' when notable_point_name_compatible = 1 and notable_point_distance_m <= 8 then 'low' else 'spatial_only_review' end match_class, count(*) n from trees group by 1",
    "flag_labels": "with t as (select concat_ws(' ', case when is_protected_notable = 1 then 'protected' end, case when notable_group_match = 1 then 'group' end, case when notable_point_review_required = 1 then 'review:' || coalesce(notable_point_type, '-') end) f from trees) select case when f <> '' then 'Tree (' || f || ')' else 'Tree' end as label, count(*) n from t group by 1",
    "growth_class_of_names": f"with p as (select p_partkey, p_name || ' ' || p_type t from part) select p_partkey, {CLS} as class from p",
    "taxon_normalise": f"with {_TAX} select point_id, case when g then a end genus, case when g and not mk and regexp_full_match(e, '[a-z][a-z-]+') then a || case when hy then ' x ' else ' ' end || e end species, case when g and not mk and regexp_full_match(e, '[a-z][a-z-]+') then 'species_exact' when g then 'genus_only' else 'unknown' end as scope from tw",
    "taxon_keys": f"with t as (select point_id, {clean_sql('scientific_name')} t from nz_tree_points), u as (select point_id, t, string_split(lower(t), ' ') w from t) select point_id, case when len(w) >= 2 and not regexp_full_match(w[2], 'spp?\\.?') then array_to_string(w[1:case when w[2] in ('x', '×') then 3 else 2 end], ' ') end taxon, case when regexp_full_match(split_part(t, ' ', 1), '[A-Z][a-z]+') then split_part(t, ' ', 1) end genus from u",
    "display_names": f"with t as (select point_id, {clean_sql('scientific_name')} t from nz_tree_points) select point_id, nullif(trim(regexp_replace(t, '''[^'']*''', '', 'g')), '') as name, nullif(regexp_extract(t, '''([^'']+)''', 1), '') cultivar, coalesce(regexp_matches(trim(regexp_replace(t, '''[^'']*''', '', 'g')), '[,;/&]'), false) several from t",
    "street_normalise": f"with {ADDRESS_SQL}, n as (select k, rtrim({STREET_SQL}, '$') street_norm from addr) select k, street_norm, substr(regexp_replace(street_norm, '[^a-z0-9]', '', 'g'), 1, 2) shard from n",
    "unit_number_split": f"with {ADDRESS_SQL} select k, upper(case when contains(number, '/') and unit is null then split_part(number, '/', 2) else number end) number, nullif(upper(case when contains(number, '/') and unit is null then split_part(number, '/', 1) else coalesce(regexp_replace(unit, '(?i)^(unit|flat|apartment|apt)\\s*', ''), '') end), '') unit from addr",
    "number_parse": f"select distinct {ID} id, try_cast(source_tree_id as double) v from trees",
    "address_query_parse": f"with {ADDRESS_SQL} select k, coalesce(case when contains(number, '/') then split_part(number, '/', 1) end, case when unit is not null then '7' end) unit, upper(case when contains(number, '/') then split_part(number, '/', 2) else number end) number, street, suburb from addr",
    "stem_sizes": """with a as (select case when contains(lower(growth_setting), 'forest') then 'conifer' when contains(lower(growth_setting), 'stand') then 'palm_other' else 'evergreen_broadleaf' end cls, greatest(height_max_m, 0) h, greatest(2 * sqrt(crown_volume_m3 / pi()), 0) d from tree_assets_pilot),
b as (select cls, h, d, case cls when 'palm_other' then 2.0 + 1.2 * coalesce(h, 0) when 'conifer' then 1.5 * coalesce(h, 0) + 0.02 * coalesce(h, 0) * coalesce(h, 0) else 1.6 * coalesce(h, 0) + 0.04 * coalesce(h, 0) * coalesce(h, 0) end x, coalesce(d, 0) * case cls when 'conifer' then 1.2 when 'palm_other' then 0.8 else 1.7 end y from a),
e as (select cls, case when coalesce(d > 0 and h > 0, false) then 'modelled_medium' else 'modelled_low' end conf, round(greatest(case when coalesce(d > 0 and h > 0, false) then 0.5 * x + 0.5 * y when coalesce(h > 0, false) then x else y end, 3), 6) dbh, round(greatest(x, 5), 6) dbh_h from b)
select cls, conf, count(*) n, round(sum(dbh), 3) dbh, round(sum(dbh_h), 3) dbh_h from e group by 1, 2""",
    "carbon_by_class": f"""with j as (select p_name || ' ' || p_type t, l_quantity h, l_extendedprice / 1000 area, abs(l_discount) * 10 sealed from lineitem join part on l_partkey = p_partkey),
k as (select {CLS} as class, h, area, case when sealed between 0 and 1 then sealed else 0.35 end s from j), m as (select *, greatest({_CO}, 5.0) dbh from k),
n as (select *, case class when 'palm_other' then 15.0 * dbh when 'conifer' then 0.053 * pow(dbh, 2.62) when 'deciduous_broadleaf' then 0.06 * pow(dbh, 2.5) else 0.083 * pow(dbh, 2.46) end agb from m),
o as (select class, agb, agb * (1 + case class when 'conifer' then 0.22 when 'palm_other' then 0.20 else 0.24 end) * case class when 'conifer' then 0.5 when 'palm_other' then 0.45 else 0.47 end * 44.0 / 12.0 / 1000 co2,
 area * 1.24 * case class when 'conifer' then 0.2 when 'palm_other' then 0.12 when 'deciduous_broadleaf' then 0.1 else 0.18 end * (0.3 + 0.6 * s) r, area * case class when 'conifer' then 3.0 when 'palm_other' then 2.0 when 'deciduous_broadleaf' then 2.5 else 4.0 end * 0.008 p from n)
select class, count(*) n, round(sum(agb), 2) above_kg, round(sum(co2), 4) co2_t, round(sum(r), 4) avoided_m3, round(sum(p), 4) particles_kg, round(sum(co2) * 0.7, 4) co2_low, round(sum(co2) * 1.3, 4) co2_high from o group by 1""",
    "life_stages": """with a as (select l_quantity h, l_extendedprice / 1000 area, case l_returnflag when 'A' then 'conifer' when 'N' then 'palm_other' else 'deciduous_broadleaf' end cls from lineitem),
b as (select *, h / case cls when 'conifer' then 35.0 when 'palm_other' then 14.0 else 25.0 end f, area / case cls when 'conifer' then 2.0 when 'palm_other' then 0.6 else 2.6 end y from a)
select cls, case when f < 0.18 then 'juvenile' when f < 0.35 then 'young' when f < 0.6 then 'semi-mature' when f < 0.9 then 'mature' else 'veteran' end stage,
 case when y >= 80 or h >= 25 then 'effectively_irreplaceable' when y >= 40 then 'very_high' when y >= 15 then 'high' when y >= 5 then 'moderate' else 'low' end replaceability,
 case when h < 5 then 'under 5' when h < 10 then '5-10' when h < 20 then '10-20' else '20+' end as band, count(*) n, round(sum(case when h >= 5 then floor(f * 1000) / 10 end), 3) pct from b group by 1, 2, 3, 4""",
    "fnv_bucket": f"with t as (select distinct {ID} id from trees), u as (select id, list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, strlen(id) + 1), lambda i: ascii(substr(id, i::int, 1))::bigint)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) h from t) select id, h, h % 4096 bucket from u",
    "stable_ids": """with o as (select o_orderkey k, case when o_orderkey % 3 <> 0 then (o_orderkey % 1000) / 4.0 end a, case when o_orderkey % 2 = 0 then (o_orderkey % 777) / 4.0 end b, (o_orderkey % 555) / 4.0 e from orders)
select k o_orderkey, 'traj_' || substr(sha256(concat_ws('|', '2013:' || printf('%.2f', a::double) || ':' || printf('%.2f', (a * 2)::double), '2016:' || printf('%.2f', b::double) || ':' || printf('%.2f', (b * 2)::double), '2024:' || printf('%.2f', e::double) || ':' || printf('%.2f', (e * 2)::double))), 1, 20) sid,
 'tree_' || substr(sha256('canonical:' || k), 1, 20) cid from o""",
    "spatial_folds": f"""with t as (select distinct {ID} id, approx_x_m x, approx_y_m y from trees where approx_x_m is not null and approx_y_m is not null),
u as (select id, floor(x / 200)::bigint bx, floor(y / 200)::bigint by_, x - 200 * floor(x / 200) lx, y - 200 * floor(y / 200) ly from t),
v as (select *, ('0x' || substr(sha256(bx || ':' || by_), 1, 8))::bigint % 10 f from u)
select id, case when f < 6 then 'train' when f < 8 then 'validation' else 'test' end fold, lx < 15 or lx > 185 or ly < 15 or ly > 185 edge, bx || '_' || by_ as block from v""",
    "check_numbers": f"""with p as (select c_custkey k, {_PAYLOAD} s from customer), q as (select k, s, (32 - {_luhn_sql('s', 6, 2)}) % 32 d from p),
r as (select k, s, 'T' || s || substr('{ids.ALPHABET}', d::int + 1, 1) number, s || '0' w from q)
select k, number, true ok, {_luhn_sql('w', 7, 1)} = 0 typed_ok from r""",
    "near_number_candidates": f"""with p as (select c_custkey k, ({_PAYLOAD}) || '7' s from customer), bad as (select k, s from p where {_luhn_sql('s', 7, 1)} <> 0),
subs as (select k, s, substr(s, 1, i - 1) || substr('{ids.ALPHABET}', a, 1) || substr(s, i + 1) n from bad, (select unnest(range(1, 8))::int i), (select unnest(range(1, 33))::int a)),
swaps as (select k, s, substr(s, 1, i - 1) || substr(s, i + 1, 1) || substr(s, i, 1) || substr(s, i + 2) n from bad, (select unnest(range(1, 7))::int i)), u as (select k, s, n from subs union select k, s, n from swaps)
select k, 'T' || n near from u where n <> s and {_luhn_sql('n', 7, 1)} = 0""",
    "key_kinds": f"""with p as (select {_PAYLOAD} s from customer), k as (select {ID} k from trees union all select new_seg_key from tree_crown_lineage_v5 union all select '@' from p)
select case when k is null then null when k = '@' then 'number' when regexp_full_match(k, '[A-Za-z0-9_]+:-?\\d+(\\.\\d+)?:-?\\d+(\\.\\d+)?') then 'crown_key' when starts_with(k, 'akl_') then 'record' else 'other' end kind, count(*) n from k group by 1""",
    "significant_figures": "with o as (select o_totalprice p, pow(10.0, 2 - floor(log10(abs(o_totalprice)))) s from orders) select round(p * s) / s v, count(*) n from o group by 1",
    "one_edit_apart": "with p as (select distinct split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b from part) select a, b, true swap, damerau_levenshtein(a, b) <= 1 near, true longer from p",
    "height_phrases": "select o_orderkey, case when o_orderkey % 7 <> 6 and o_orderkey % 90 between 2 and 60 then (o_orderkey % 90)::int end as least from orders",
    "circle_sizes": "select p_partkey, round(2 * sqrt(p_retailprice / pi()), 6) diameter, round(least(greatest(2.5 + 0.25 * p_size, 3), 12), 6)::double r, round(least(greatest(1.5 + 0.15 * p_size, 2), 6), 6)::double r4, round(greatest(least(-pow((p_size - 25.0) / 8.0, 2) / 2 - ln(8.0 * sqrt(2 * pi())) - ln(0.05), 3.0), -6.0), 6) llr from part",
    "sentence_flag_counts": """with s as (select doc_id, regexp_split_to_array(coalesce(lower(text), ''), '[.;!?\\n]+') s, text from documents),
f as (select doc_id, text, list_filter(s, lambda x: not regexp_matches(x, '\\b(no|not|without)\\b')) s from s)
select doc_id, concat_ws(';', case when len(list_filter(s, lambda x: regexp_matches(x, 'measured|height'))) > 0 then 'measured' end, case when len(list_filter(s, lambda x: regexp_matches(x, 'root plate|drip line'))) > 0 then 'root' end, case when len(list_filter(s, lambda x: contains(x, 'wrong name'))) > 0 then 'wrong' end) flags,
 coalesce(regexp_matches(text, '[ÃÂÄÅ][\\x{80}-\\x{BF}]|â€|\\x{FFFD}'), false) garbled, coalesce(regexp_matches(text, '(?i)\\bschool\\b'), false) school from f""",
    "record_signatures": f"select distinct {ID} id, concat_ws('|', lower(trim(notable_point_type)), lower(trim(notable_point_name)), printf('%.7f', lon), printf('%.7f', lat)) sig from trees where notable_point_name is not null and lon is not null",
    "pixel_indices": """with l as (select distinct l_quantity r, l_extendedprice % 256 g, abs(l_discount) * 1000 % 256 b from lineitem), m as (select *, greatest(r, g, b) hi, greatest(r, g, b) - least(r, g, b) dd from l)
select r, g, b, round((2 * g - r - b) / nullif(2 * g + r + b, 0), 6) gli, round((g - r) / nullif(g + r, 0), 6) nd,
 round(case when dd = 0 then null when hi = r then ((g - b) / dd * 60 + 360) % 360 when hi = g then (b - r) / dd * 60 + 120 else (r - g) / dd * 60 + 240 end, 4) hue, round(coalesce(dd / nullif(hi, 0), 0), 6) sat from m""",
    "epoch_years": "select year(o_orderdate)::int y, case when starts_with(o_orderpriority, '1') then 'a' when regexp_matches(o_orderpriority, '^[23]') then 'b' else 'c' end tier, count(*) n from orders group by 1, 2",
    "export_values": "select nullif(round(l_discount, 3), 0) disc, nullif(round(l_tax, 3), 0) tax, count(*) n from lineitem group by 1, 2",
    "slippy_tiles": f"""with t as (select distinct {ID} id, lon, lat from trees where lon between 170 and 180 and lat between -50 and -30),
u as (select id, floor((lon + 180) / 360 * 65536)::bigint x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536)::bigint y from t)
select id, x, y, round(x / 65536 * 360 - 180, 6) west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 65536)))), 6) north from u""",
    "projected_points": "select distinct candidate_id, true fits, round(lon * 111320.0 * cos(radians(-37.0)), 3) ex, round(lon, 7) lon, round(lat, 7) lat from tree_low_canopy_candidates where lon is not null",
    "root_zones": """with r as (select least(dbh_cm * 0.12, 15.0) p, crown_radius_m c, case when stability_radius_m > 2 then stability_radius_m % 1 end s from tree_root_zone_pilot where dbh_cm is not null and crown_radius_m is not null),
q as (select p, s, pow(greatest(p, c * 1.5), 2) * pi() * (1 - s) a from r)
select case when s is null then 'not_assessed' when s >= 0.6 then 'severe' when s >= 0.3 then 'moderate' else 'low' end flag, count(*) n, round(sum(p), 4) protection_m, round(sum(a), 3) area_m2 from q group by 1""",
}
