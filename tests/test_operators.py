"""Library operators against small brute-force versions and worked examples."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovekit.functions import filters, geo, growth, ids, text
from grovekit.operators import graph, publish, relational, spatial, survey
from grovekit.sources import io
from grovekit.streaming import incremental

c = F.col


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_tree_numbers(spark):
    n = ids.number_text(F.lit("t-mctt 6x.4"))
    assert one(spark, n, ids.valid_number(n), ids.check_char(F.lit("MCTT6X"))) == ["TMCTT6X4", True, "4"]
    assert one(spark, ids.valid_number(F.lit("TMCTT6X5")), ids.valid_number(F.lit(None).cast("string"))) == [False, False]
    near = one(spark, ids.near_numbers(F.lit("TMCTT6X5")), ids.near_numbers(F.lit("TMCTT6X4")))
    assert "TMCTT6X4" in near[0] and near[1] == [] and len(near[0]) >= 7


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    for s in ("", "a", "pōhutukawa", "x" * 300):
        assert one(spark, ids.fnv1a(F.lit(s))) == [fnv(s)]
    assert one(spark, ids.fnv1a(F.lit(None).cast("string"))) == [None]


def test_text_functions(spark):
    t = text
    assert one(spark, t.clean_text(F.lit("  N/A ")), t.clean_text(F.lit(" a \n b "))) == [None, "a b"]
    got = one(spark, *[t.norm_street(F.lit(s)) for s in ("St Mary's Rd", "Ōrākei  Cres.", "Mt Eden", "St", "", "High St")])
    assert got == ["saint marys road", "orakei crescent", "mount eden", "st", "", "high street"]
    q = lambda s: list(one(spark, t.address_query(F.lit(s)))[0])
    assert q("2/15a Grattan Place, Ponsonby") == ["2", "15A", "Grattan Place", "Ponsonby"] and q("Flat 3, 9 High St") == ["3", "9", "High St", ""] and q("High St") == [None, None, "High St", ""]
    h = lambda s: one(spark, t.height_phrase(F.lit(s)))[0]
    assert [h(s) for s in ("taller than 25 m", "over 20m", "15+", "30 m or more", "over 99", "tall")] == [25, 20, 15, 30, None, None]
    p = lambda a, b: one(spark, t.phrase_score(t.search_query(F.lit(a))["tokens"], F.lit(b)))[0]
    assert p("silver birch", "Silver Birch") == 100 and 82 <= p("silv", "Silver birch") < 92 and p("birch", "Silver birch") == 78 and p("birch silver", "silver birch") == 70
    assert p("slver birch", "silver birch") == 45 and p("oak", "silver birch") == 0 and p("", "silver") == 0
    assert one(spark, t.search_query(F.lit("show me the tall oaks"))) [0]["intent"] == "on"
    x = one(spark, t.taxon_parts(F.lit("Acer x freemanii 'Autumn'")), t.taxon_parts(F.lit("Acer sp.")), t.taxon_parts(F.lit("unknown")), t.taxon_parts(F.lit(None).cast("string")))
    assert [tuple(v) for v in x] == [("Acer", "Acer x freemanii", "species_exact"), ("Acer", None, "genus_only"), (None, None, "unknown"), (None, None, "unknown")]
    assert one(spark, t.names_compatible(F.lit("Oak tree"), F.lit("Quercus robur"), F.lit("Old oak (group)")), t.names_compatible(F.lit("Ash"), F.lit("Fraxinus x"), F.lit("Oak"))) == [True, False]
    assert t.resolve_field(["HEIGHT (m)", "Botanical_Name"], ["botanical name"]) == "Botanical_Name" and t.resolve_field(["a"], ["zz"]) is None
    assert one(spark, t.number_of(F.lit("NaN")), t.number_of(F.lit(" 3.5 ")), t.number_of(F.lit("x")), t.number_of(F.lit("Infinity"))) == [None, 3.5, None, None]
    assert one(spark, *[t.significant(F.lit(v), 2) for v in (0.0, 1234.0, 0.0456)]) == [0.0, 1200.0, 0.046]


def test_growth(spark):
    k = lambda a, b: one(spark, growth.growth_class(F.lit(a), F.lit(b)))[0]
    assert [k("Japanese maple", "Acer palmatum"), k("Fan palm", None), k("Totara", None), k(None, None)] == ["deciduous_broadleaf", "palm_other", "conifer", "evergreen_broadleaf"]
    got = one(spark, growth.dbh_from_height(F.lit(15.0), F.lit("deciduous_broadleaf")), growth.biomass_kg(F.lit(0.0), F.lit("conifer")), growth.runoff(F.lit(100.0), F.lit("conifer"), F.lit(7.0))["avoided_m3"])
    assert math.isclose(got[0], 33.0) and got[1] == 0 and math.isclose(got[2], 100 * 1.24 * 0.2 * (0.3 + 0.6 * 0.35))


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(166.5 + i * 0.5, -47 + i * 0.4) for i in range(30)], "lon double, lat double")
    g = df.withColumn("g", geo.to_grid(c("lon"), c("lat"))).withColumn("b", geo.from_grid(c("g.x"), c("g.y")))
    assert g.where((F.abs(c("b.lon") - c("lon")) > 1e-7) | (F.abs(c("b.lat") - c("lat")) > 1e-7)).count() == 0


def test_clip_convex():
    box = [(0, 0), (2, 0), (2, 2), (0, 2)]
    area = lambda p: abs(sum(p[i - 1][0] * p[i][1] - p[i][0] * p[i - 1][1] for i in range(len(p)))) / 2
    assert area(geo.clip_convex([(1, 1), (3, 1), (3, 3), (1, 3)], box)) == 1 and geo.clip_convex([(5, 5), (6, 5), (6, 6)], box) == []


@pytest.mark.parametrize("by,strict", [("dominator", False), ("self", False), ("self", True)])
def test_suppression_equals_sequential(spark, by, strict):
    rnd = random.Random(7)
    rows = [(i, float(rnd.randrange(60)), float(rnd.randrange(60)), float(rnd.randrange(5, 25))) for i in range(220)]
    df = spark.createDataFrame(rows, "id int, x double, y double, h double")
    r = lambda h: min(max(h * 0.25 + 1, 2.0), 6.0)
    kept = []
    for i, x, y, h in sorted(rows, key=lambda v: (-v[3], v[0])):
        lim = [(r(k[3]) if by == "dominator" else r(h)) for k in kept]
        d = [math.sqrt((x - k[1]) ** 2 + (y - k[2]) ** 2) for k in kept]
        if not any(a < b if strict else a <= b for a, b in zip(d, lim)):
            kept.append((i, x, y, h))
    got = graph.greedy_suppress(df, ("id", "x", "y"), [-c("h")], growth.suppression_radius(c("h"), 1.0, 0.25, 2.0, 6.0), 6.0, by=by, strict=strict)
    assert sorted(x["id"] for x in got.collect()) == sorted(k[0] for k in kept)


def test_components_and_empty(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(5, 5), (None, 3)], "a_id int, b_id int")
    got = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)}
    assert graph.components(e.limit(0)).count() == 0


def test_hungarian_equals_permutations():
    rnd = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        for _ in range(10):
            k = rnd.random((n, m))
            got = graph.hungarian(k)
            want = min(sum(k[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
            assert math.isclose(k[np.arange(n), got].sum(), want)


def test_assignment_prefers_more_pairs(spark):
    f = lambda rows: sorted((r["l"], r["r"]) for r in graph.optimal_pairs(spark.createDataFrame(rows, "cost double, l int, r int"), "l", "r", "cost").collect())
    assert f([(1.0, 0, 0), (2.0, 0, 1), (2.0, 1, 0)]) == [("0", "1"), ("1", "0")]
    assert f([(0.2, 0, 0), (0.3, 1, 0), (0.1, 2, 3)]) == [("0", "0"), ("2", "3")]


def test_assignment_of_a_large_component(spark):
    rnd = np.random.default_rng(5)
    n = 420  # a chain in which the cheapest edges first leave items unpaired, and more left than right at its end
    rows = [(float(rnd.uniform(1, 2)), i, i) for i in range(n)] + [(float(rnd.uniform(0, 1)), i, i + 1) for i in range(n - 1)] + [(0.5, n, 0), (0.25, n + 1, n - 1)]
    got = graph.optimal_pairs(spark.createDataFrame(rows, "cost double, l int, r int"), "l", "r", "cost").collect()
    m = np.full((n, n + 2), 1e4)
    for x, i, j in rows:
        m[j, i] = x
    assert len(got) == len({r["l"] for r in got}) == len({r["r"] for r in got}) == n and all(r["exact"] for r in got)
    assert math.isclose(sum(r["cost"] for r in got), m[np.arange(n), graph.hungarian(m)].sum())


def test_capacity(spark):
    e = spark.createDataFrame([(1.0, "a", "X"), (2.0, "b", "X"), (3.0, "c", "X"), (2.5, "c", "Y")], "cost double, l string, r string")
    got = {r["l"]: (r["r"], round(r["margin"], 6)) for r in graph.capacity_pairs(e, "l", "r", "cost", slots=2, penalty=1.0, null=4.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "X", "b": "X", "c": "Y"} and all(v[1] > 0 for v in got.values())


def test_capacity_of_a_large_component(spark):
    rnd = np.random.default_rng(4)
    n, crowns, slots, penalty, null = 430, 70, 3, 1.0, 9.0  # more records than places, all linked along a line
    rows = [(float(rnd.uniform(0, 8)), i, j) for i in range(n) for j in sorted({i % crowns, (i + 1) % crowns, int(rnd.integers(crowns))})]
    got = graph.capacity_pairs(spark.createDataFrame(rows, "cost double, l int, r int"), "l", "r", "cost", slots=slots, penalty=penalty, null=null).collect()
    m = np.full((n, crowns * slots + n), 1e6)
    for x, i, j in rows:
        m[i, j * slots : j * slots + slots] = x + penalty * np.arange(slots)
    m[np.arange(n), crowns * slots + np.arange(n)] = null
    least = lambda k: k[np.arange(n), graph.hungarian(k)].sum()
    cost, taken = {(i, j): x for x, i, j in rows}, [r["r"] for r in got if r["r"] is not None]
    held = [taken.count(str(j)) for j in range(crowns)]
    total = sum(null if r["r"] is None else cost[int(r["l"]), int(r["r"])] for r in got) + sum(penalty * k * (k - 1) / 2 for k in held)
    assert len(got) == n and max(held) <= slots and math.isclose(total, least(m)) and all(r["margin"] >= 0 for r in got)
    for r in [next(r for r in got if r["r"] is None), *[r for r in got if r["r"] is not None][:3]]:
        other, i = m.copy(), int(r["l"])
        other[i, slice(crowns * slots + i, crowns * slots + i + 1) if r["r"] is None else slice(int(r["r"]) * slots, int(r["r"]) * slots + slots)] = 1e6
        assert math.isclose(r["margin"], least(other) - total, abs_tol=1e-6)


def test_nearest_and_k_nearest(spark):
    rnd = random.Random(2)
    a = [(f"a{i}", rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(60)] + [("n", None, 1.0)]
    b = [(f"b{i}", rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(40)]
    A, B = (spark.createDataFrame(v, "id string, x double, y double") for v in (a, b))
    d = lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2])
    near = {r["a_id"]: r["b_id"] for r in spatial.nearest_within(A, B, ("id", "x", "y"), ("id", "x", "y"), 9.0).collect()}
    want = {p[0]: min((d(p, q), q[0]) for q in b) for p in a if p[1] is not None}
    assert near == {k: v[1] for k, v in want.items() if v[0] <= 9}
    got = {(r["a_id"], r["rank"]): r["b_id"] for r in spatial.k_nearest(A, B, ("id", "x", "y"), ("id", "x", "y"), 3, 2.0, 200.0).collect()}
    assert got == {(p[0], k + 1): q for p in a if p[1] is not None for k, (_, q) in enumerate(sorted((d(p, q), q[0]) for q in b)[:3])}


def test_quantiles(spark):
    rnd = random.Random(3)
    rows = [("big", float(rnd.randrange(100))) for _ in range(101)] + [("small", 3.0), ("small", 1.0), ("small", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r["g"]: r for r in relational.quantile_table(df, ["g"], "v", [0.1, 0.5, 0.99]).collect()}
    assert q["small"]["exact"] == [1.0, 3.0] and q["small"]["q"] is None and np.allclose(q["big"]["q"], np.percentile([v for g, v in rows if g == "big"], [10, 50, 99]))
    import statistics

    for n in (2, 3, 7, 10):
        v = [float(rnd.randrange(50)) for _ in range(n)]
        e = relational.exclusive_quantile(spark.createDataFrame([(1, x) for x in v], "g int, v double"), ["g"], "v", 0.25).first()["v"]
        if n > 2:
            assert math.isclose(e, statistics.quantiles(v, n=4)[0])
        u = relational.value_at(spark.createDataFrame([(1, x) for x in v], "g int, v double"), ["g"], "v", F.floor(c("n") / 2) + 1).first()["v"]
        assert u == sorted(v)[n // 2]
    p = lambda v: one(spark, relational.percentile_in(F.lit(v), F.array(*[F.lit(x) for x in (1.0, 2.0, 2.0, 4.0)]), F.array(*[F.lit(x) for x in (0.0, 0.3, 0.5, 1.0)])))[0]
    assert [p(0.0), p(1.0), p(1.5), p(2.0), p(3.0), p(9.0)] == [0.0, 0.0, 15.0, 40.0, 75.0, 100.0]
    assert one(spark, relational.mid_rank(F.lit(2.0), F.array(*[F.lit(x) for x in (1.0, 2.0, 2.0, 4.0)]))) == [0.5]


def test_samples(spark):
    df = spark.range(100).select((c("id") % 3).cast("string").alias("s"), c("id"))
    got = relational.stratified_sample(df, ["s"], {"0": 5, "1": 2}, "id").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"0": 5, "1": 2}
    e = [r["id"] for r in relational.evenly_spaced(df.withColumn("g", F.lit(1)), ["g"], ["id"], 5).orderBy("id").collect()]
    assert len(e) == 5 and e[0] == 0 and e[-1] == 99
    b = relational.block_bootstrap(df.withColumn("v", c("id") * 1.0), "s", "v").first()
    assert b["n_blocks"] == 3 and b["lo"] <= b["mean"] == 49.5 <= b["hi"]


def test_wilson(spark):
    lo, hi = one(spark, relational.wilson(F.lit(8), F.lit(10)))[0]
    assert round(lo, 4) == 0.4902 and round(hi, 4) == 0.9433 and list(one(spark, relational.wilson(F.lit(0), F.lit(0)))[0]) == [None, None]


def test_fates(spark):
    nan = float("nan")
    rows = [
        (True, None, None, 12.0, 0.2, "outside_historic_coverage"), (True, 8.0, 9.0, 10.0, 0.2, "persistent"), (True, 1.0, 1.0, 7.0, 0.2, "established_since_2013"), (True, 8.0, 1.0, 7.0, 0.2, "established_since_2016"),
        (False, 8.0, 8.0, 1.0, 0.0, "removed_to_open"), (False, 8.0, 8.0, 9.0, 0.0, "candidate_conversion"), (False, 8.0, nan, 9.0, 0.3, "persistent"), (False, nan, nan, nan, nan, "indeterminate"), (None, None, None, None, None, "indeterminate"),
    ]
    df = spark.createDataFrame(rows, "p boolean, a double, b double, k double, g double, want string")
    assert df.where(survey.fate(c("p"), c("a"), c("b"), c("k"), c("g")) != c("want")).count() == 0


def test_segmentation_of_two_hills(spark):
    h = {(i, j): max(0.0, 20 - math.hypot(i - 10, j - 30) * 2, 15 - math.hypot(i - 70, j - 30) * 2) for i in range(90) for j in range(60)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in h.items()], "i long, j long, h double")
    got = {(r["i"], r["j"]): r for r in survey.segment_crowns(df).collect()}
    assert set(got) == {(10, 30), (70, 30)} and got[(10, 30)]["n_cells"] == sum(1 for (i, j), v in h.items() if math.hypot(i - 10, j - 30) <= 5)


def test_pav_and_em():
    y = survey.pav_decreasing(np.array([3.0, 4.0, 1.0, 2.0]), np.ones(4))
    assert y.tolist() == [3.5, 3.5, 1.5, 1.5]
    llr, share = survey.offset_evidence(np.array([300, 200, 60, 50, 50], float), np.array([0.05] * 5), 1000)
    assert np.all(np.diff(llr) <= 1e-12) and 0.3 < share < 0.6


def test_conditional_logit(spark):
    rnd = np.random.default_rng(0)
    rows = []
    for q in range(300):
        x = rnd.normal(size=(4, 2))
        u = x @ np.array([2.0, -1.0]) + rnd.gumbel(size=4)
        rows += [(q, float(i == u.argmax()), float(x[i, 0]), float(x[i, 1])) for i in range(4)]
    w = survey.conditional_logit(spark.createDataFrame(rows, "q int, y double, a double, b double"), "q", "y", ["a", "b"])
    assert abs(w[0] - 2) < 0.5 and abs(w[1] + 1) < 0.4


def test_run_alignment(spark):
    m = spark.createDataFrame([(f"t{i}", "r", i * 8.0, 0.0) for i in range(6)], "id string, run string, x double, y double")
    tops = spark.createDataFrame([(f"c{i}", i * 8.0 + 3.0, 2.0) for i in range(6)] + [("far", 900.0, 900.0)], "id string, x double, y double")
    r = survey.align_runs(m, tops, ("id", "x", "y")).first()
    assert (round(r["dx"], 6), round(r["dy"], 6), round(r["after"], 6)) == (3.0, 2.0, 0.0)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "7"), (3, None, "x")], "n int, s string, t string")
    f = lambda e: [r["n"] for r in df.where(filters.compile_filter(e, df.columns)).orderBy("n").collect()]
    assert f(None) == [1, 2, 3] and f(["any"]) == [] and f(["==", ["get", "s"], "a"]) == [1] and f(["!=", ["get", "s"], "a"]) == [2, 3]
    assert f(["in", ["get", "s"], ["literal", ["a", "b"]]]) == [1, 2] and f(["!", ["has", "t"]]) == [1] and f([">", ["to-number", ["get", "t"]], 5]) == [2]
    assert f(["match", ["get", "s"], ["a"], True, False]) == [1] and f(["case", ["==", ["get", "n"], 3], True, False]) == [3] and f(["get", "absent"]) == []
    assert f(["all", [">=", ["get", "n"], 2], ["none", ["==", ["get", "s"], "b"]]]) == [3] and filters.selection("s", ["a"], ["a"]) is None
    with pytest.raises(filters.FilterError):
        filters.compile_filter(["drop", 1], df.columns)


def test_sets_and_guards(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    s = lambda d: sorted(map(tuple, d.collect()))
    assert s(relational.upsert(a, b, "k")) == [(1, "x"), (2, "z"), (3, "w")] and s(relational.upsert(a, b, "k", False)) == [(1, "x"), (2, "y"), (3, "w")]
    assert s(relational.replace_slices(a, b, "k")) == [(1, "x"), (2, "z"), (3, "w")]
    with pytest.raises(ValueError):
        relational.assert_unique(a.unionByName(a), ["k"])
    assert relational.assert_unique(a, ["k"]) is a
    j = relational.star_join(a, [(b, "k"), (b, "k")])
    assert j.columns == ["k", "v", "v_1", "v_2"] and j.count() == 2
    assert publish.fingerprint(a).first() == publish.fingerprint(a.repartition(3)).first() != publish.fingerprint(b).first()


def test_geojson_and_shards(spark, tmp_path):
    feats = [{"type": "Feature", "properties": {"id": i, "name": 'a "quoted" {brace}' if i else None}, "geometry": {"type": "Point", "coordinates": [174.0 + i, -37.0]}} for i in range(5)]
    import json

    p = tmp_path / "f.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    schema = T.StructType.fromDDL("id int, name string")
    got = io.read_geojson(spark, str(p), schema).orderBy("id").collect()
    assert len(got) == 5 and got[1]["coordinates"] == [175.0, -37.0] and got[0]["name"] is None
    assert [json.loads(r["feature"]) for r in io.features_of_text(spark, str(p), size=7).collect()] == feats
    df = spark.createDataFrame([(f"k{i}", i, None if i % 2 else "v") for i in range(50)], "k string, n int, s string")
    sh = publish.key_shards(df, "k", ["n", "s"], 16)
    io.write_shards(sh, str(tmp_path / "sh"), 3)
    back = {k: v for r in io.read_shards(spark, str(tmp_path / "sh")).collect() for k, v in json.loads(r["body"]).items()}
    assert len(back) == 50 and back["k4"] == {"n": 4, "s": "v"}
    io.write_features(df.withColumn("lon", F.lit(1.0)).withColumn("lat", F.lit(2.0)), publish.feature_json(["k", "s"], "lon", "lat"), str(tmp_path / "g"))
    lines = io.read_geojson_lines(spark, str(tmp_path / "g"), T.StructType.fromDDL("k string"))
    assert lines.count() == 50 and lines.first()["lon"] == 1.0


def test_csv_tiles_slices_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\tv\tw\n1\t2.5\tx\nzz\t\ty\n")
    d = io.read_csv_typed(spark, str(tmp_path / "a.csv"), {"id": "int", "v": "double", "absent": "string"}, sep="\t")
    assert sorted(map(tuple, d.collect()), key=str) == [(1, 2.5, None), (None, None, None)]
    with pytest.raises(ValueError):
        io.verify_count(d, 3, "csv")
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", 3.0), (2, "b", 1.0)], "k int, s string, v double")
    df.write.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, io.read_tiles(spark, str(tmp_path / "t"), ["k"], ["v"]).select("k", "v").collect())) == [(1, 3.0), (2, 1.0)]
    io.write_slices(df, str(tmp_path / "s"), "s")
    io.write_slices(df.where("s = 'b'").withColumn("v", F.lit(9.0)), str(tmp_path / "s"), "s")
    assert sorted((r["s"], r["v"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 3.0), ("a", 5.0), ("b", 9.0)]
    io.write_export(df, str(tmp_path / "e"), {"k": "key", "v": "value"})
    assert io.dictionary(spark.read.parquet(str(tmp_path / "e/parquet"))) == [("k", "int", "key"), ("v", "double", "value")]
    m = spark.createDataFrame([], "name string, release string, path string, rows long")
    m = io.register(m, "x", "6", "p", 1)
    with pytest.raises(ValueError):
        io.register(m, "x", "7", "p", 1)
    assert "| a | 2 |" in io.count_report(df, "s")


def test_streaming(spark, tmp_path):
    led = spark.createDataFrame([("a", 1, "new"), ("a", 2, "removed"), ("b", 1, "new")], "k string, n int, s string")
    incremental.append(led, str(tmp_path / "l"))
    assert [r["k"] for r in incremental.latest(spark.read.schema("k string, n int, s string").json(str(tmp_path / "l")), "k", "n", "s").collect()] == ["b"]
    stream = incremental.read_ledger(spark, str(tmp_path / "l"), "k string, n int, s string")
    agg = {"total": ("n", "sum"), "rows": ("n", "count"), "top": ("n", "max")}
    for _ in range(2):
        q = incremental.upsert_batches(stream, ["k"], agg, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        incremental.append(led.where("k = 'b'"), str(tmp_path / "l"))
    got = {r["k"]: (r["total"], r["rows"], r["top"]) for r in incremental.read_totals(spark, str(tmp_path / "out"), ["k"], agg).collect()}
    assert got == {"a": (3, 2, 2), "b": (2, 2, 1)}


def test_alias_table(spark):
    l = spark.createDataFrame([("o1", "n1"), ("o2", "n2"), ("o3", "n2"), ("o4", "n3"), ("o4", "n4"), (None, "n9")], "o string, n string")
    alive = spark.createDataFrame([("n1",), ("o9",)], "k string")
    t = publish.alias_table(l, "o", "n", alive, "k")
    got = {r["key"]: r["status"] for r in publish.resolve(spark.createDataFrame([(x,) for x in ("o1", "o2", "o4", "o9", "zz")], "k string"), "k", t).collect()}
    assert got == {"o1": "current", "o2": "merged", "o4": "split", "o9": "current", "zz": "unknown"}


def test_signatures_and_splits(spark):
    o = spark.createDataFrame([("s", 1), ("m", 2), ("d", 3), ("d", 4), ("g", 5)], "sig string, id int")
    n = spark.createDataFrame([("s", 1), ("m", 9), ("d", 3), ("a", 7)], "sig string, id int")
    got = {r["sig"]: r["state"] for r in relational.reconcile_signatures(o, n, "sig", "id", "id").collect()}
    assert got == {"s": "same", "m": "renumbered", "d": "ambiguous", "g": "gone", "a": "added"}
    s = relational.deficit_splits([(f"b{i}", 10) for i in range(20)], {"train": 0.7, "test": 0.3})
    assert sum(v == "train" for v in s.values()) == 14




def test_search_pairs_lose_nothing_that_scores(spark):
    """Against the score of every pair: prefixes, middles of words, swaps, errors at the beginning and at the end."""
    labels = ["silver bunting", "broad leaved oxmere", "kanuka", "tall marsh tolmion", "ab cd", "x", "northern rata", None, "", "kanuka"]
    typed = ["kan", "lver", "oxmere", "oxmree", "xomere", "bxmere", "anuka", "kanukka", "kanuk", "tolmoin", "otlmion", "tolmino", "marsh tall", "b", "cd ab", "nuk", "zanuka", "ratta north", "", None, "zzzzz", "leave", "northenr", "ilver bunting", "marsh tolmion trees"]
    items = spark.createDataFrame(list(enumerate(labels)), "i int, label string")
    q = spark.createDataFrame([(t,) for t in typed], "typed string").withColumn("tokens", text.search_query(F.col("typed"))["tokens"])
    score = text.phrase_score(F.col("tokens"), F.col("label"))
    want = {(r[0], r[1]) for r in q.crossJoin(items).where(score > 0).select("typed", "i").collect()}
    got = {(r[0], r[1]) for r in publish.search_pairs(q, "typed", "tokens", items, "i", "label").where(score > 0).select("query", "item_id").collect()}
    assert got == want and {("xomere", 1), ("bxmere", 1), ("nuk", 2), ("zanuka", 2), ("otlmion", 3)} <= got
    best = publish.ranked_search(q, "typed", items.withColumn("g", F.lit("all")), "label", "g", "i", 3, 10, 45.0).where("query = 'anuka'").collect()
    assert [(r["rank"], r["item_id"]) for r in best] == [(1, 2), (2, 9)]


def two_hills():
    """Two hills of 20 and 12 m, eleven cells apart, on a plain of 1 m."""
    return {(i, j): max(20 - 2.0 * math.dist((i, j), (8, 8)), 12 - 1.5 * math.dist((i, j), (19, 8)), 1.0) for i in range(30) for j in range(18)}


def test_growers_part_two_hills(spark):
    h = two_hills()
    peaks = [(8, 8), (19, 8)]
    grown = survey.mean_grow(h, peaks, 0.45, 0.55, 9.0)
    assert all(h[q] > 0.45 * h[peaks[k]] for q, k in grown.items()) and set(grown.values()) == {0, 1}
    assert all(h[q] <= 1.05 * h[peaks[k]] and math.dist(q, peaks[k]) < 9 for q, k in grown.items())
    beside = lambda q: [(q[0] + a, q[1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    assert all(q in peaks or any(grown.get(x) == k for x in beside(q)) for q, k in grown.items())
    assert all(grown[(8 + a, 8)] == 0 and grown[(19 + b, 8)] == 1 for a in range(-3, 4) for b in range(-2, 3))
    spaced = survey.spacing_grow(h, lambda v: 1.5, 3.0)
    assert spaced[(8, 8)] != spaced[(19, 8)] and len({spaced[p] for p in peaks}) == 2
    # against the rule itself: each cell follows its nearest taller one
    for q, k in spaced.items():
        higher = [p for p in spaced if (-h[p], p) < (-h[q], q) and math.dist(p, q) <= 1.5]
        assert not higher or spaced[min(higher, key=lambda p: (math.dist(p, q), p))] == k
    cells = spark.createDataFrame([(*q, v) for q, v in h.items()], "i long, j long, h double")
    for way in ("watershed", "mean", "spacing"):
        kw = {"share": 0.05} if way == "spacing" else {}
        whole = {(r["i"], r["j"]): r["n_cells"] for r in survey.segment_crowns(cells, way=way, **kw).collect()}
        assert set(peaks) <= set(whole) and all(n >= 1 for n in whole.values()) and sum(whole.values()) <= len(h)
        assert way == "spacing" or set(whole) == set(peaks)
    with pytest.raises(ValueError):
        survey.segment_crowns(cells, way="other")


def test_record_crowns_use_free_cells_only(spark):
    h = two_hills()
    cells = spark.createDataFrame([(*q, v) for q, v in h.items()], "i long, j long, h double")
    taken = cells.where("i < 13")
    rec = spark.createDataFrame([("a", 19.4, 8.6), ("b", 18.7, 8.1), ("far", 5.0, 5.0), ("none", None, 1.0)], "id string, x double, y double")
    got = {r["id"]: r for r in survey.record_crowns(cells, taken, rec, ("id", "x", "y"), 1.0, 2.0, most=4.0).collect()}
    assert set(got) == {"a", "b"} and (got["a"]["i"], got["a"]["j"]) == (19, 8) and got["a"]["n_cells"] == got["b"]["n_cells"]
    assert got["a"]["n_cells"] == sum(1 for q, v in h.items() if q[0] >= 13 and v >= 6 and math.dist(q, (19, 8)) <= 4)
