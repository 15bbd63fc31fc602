import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovekit.llm.canon import Trie, canonical_entries, entries_within, match_text, reference_trie
from grovekit.llm.linkage import agreement, candidate_pairs, copy_classes, em, link_patterns, link_points, meant_position, name_parts

REF = [
    (1, "Alunia serrata", "Alunia", "silver bunting", "whārūke; Doria prima", "species"),
    (2, "Alunia longifolia", "Alunia", "marsh tolmion", None, "species"),
    (3, "Alunia sp.", "Alunia", None, None, "genus"),
    (4, "Bertola vindescens", "Bertola", "broad-leaved oxmere", "mione", "species"),
]


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12), st.text("abc", min_size=1, max_size=7), st.integers(0, 3))
def test_automaton_equals_brute_force(names, text, most):
    trie = Trie()
    for n in names:
        trie.add(n, n)
    want = sorted({(lev(n, text), n) for n in names if lev(n, text) <= most})
    assert sorted({(d, e) for d, e, _, _ in trie.search(text, most)}) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Alunia serrata", 1), ("ALUNIA  SERRATA", 1), ("alunia_serrata", 1), ("serrata, Alunia", 1), ("A. serrata", 1), ("Alunia x serrata", 1), ("Alunia × serrata", 1),
        ("Alunia serata", 1), ("Alnuia serrata", 1), ("Alunia serrata 'Moonrise'", 1), ("Alunia serrata var. alba", 1), ("Alunia serrata (Voss) Lindk.", 1), ("cf. Alunia serrata", 1),
        ("? Alunia serrata", 1), ("Silver Bunting", 1), ("Bunting, silver", 1), ("silver-bunting tree", 1), ("whaaruuke", 1), ("WHĀRŪKE", 1), ("Doria prima", 1),
        ("Alunia serrata / marsh tolmion", 1), ("Alunia sp.", 3), ("Alunia spp", 3), ("Alunia", 3), ("Alunia (species unclear)", 3), ("alunia species", 3),
        ("Alunia novaspecies", None), ("Bertola sp.", None), ("Bertola", None), ("dead stump", None), ("?", None), ("B. serrata", None), ("mixed natives", None), ("broad leaved oxmere (hedge)", 4),
        ("Bértola vindescens", 4), ("", None),
    ],
)
def test_typed_names(text, want):
    got = match_text(reference_trie(REF), text)
    assert (got[0] if got else None) == want


def test_canonical_entries_edges(spark):
    ref = spark.createDataFrame(REF, "taxon_id long, scientific_name string, genus string, common_name string, other_names string, taxon_rank string")
    long_name = "great white spotted river bank oxmere"
    deep = ref.unionByName(spark.createDataFrame([(9, "Cadria rara", "Cadria", long_name, None, "species"), (None, "Null taxon", "Null", None, None, None)], ref.schema))
    assert match_text(reference_trie([tuple(r) for r in deep.where("taxon_id = 9").collect()]), f"{long_name} by the gate") == (9, 0)
    rows = [("k1", "nonsense", "silver bunting"), ("k2", None, "  "), ("k3", "Alunia serrata", "marsh tolmion"), (None, "Alunia serrata", None), ("k4", "x" * 50_000, None), ("k3", "Alunia serrata", "marsh tolmion")]
    r = spark.createDataFrame(rows, "id string, l string, c string").withColumn("key", F.lit(1)).withColumn("t0", F.lit(2))
    got = {x["key"]: (x["entry"], x["matched_from"]) for x in canonical_entries(r, F.col("id"), ["l", "c"], ref).collect()}
    assert got == {"k1": (1, "c"), "k3": (1, "l"), "k4": (0, None)}
    # every delivery's text is tried, not only the smallest
    two = spark.createDataFrame([("a", "?", None), ("a", "Unknown", "!"), ("a", "silver bunting", None), ("b", None, long_name), ("b", "not told", None)], "id string, l string, c string")
    got = {x["key"]: (x["entry"], x["matched_from"]) for x in canonical_entries(two, F.col("id"), ["l", "c"], deep).collect()}
    assert got == {"a": (1, "l"), "b": (9, "c")}
    assert {x["entry"] for x in canonical_entries(r, F.col("id"), ["l", "c"], ref.limit(0)).collect()} == {0}
    assert canonical_entries(r.limit(0), F.col("id"), ["l", "c"], ref).count() == 0


def test_size_of_the_reference_changes_no_rule(spark):
    """A tie between entries far apart in a long list means no entry, as in a short one, and all of them are listed."""
    many = [(i, f"Genusa{i:05d}x spec{i:05d}y", f"Genusa{i:05d}x", None, None, "species") for i in range(100, 21_500)]
    tied = [(1, "Bertola vindescena", "Bertola", None, None, "species"), (30_000, "Bertola vindescenb", "Bertola", None, None, "species")]
    s = "taxon_id long, scientific_name string, genus string, common_name string, other_names string, taxon_rank string"
    r = spark.createDataFrame([("k", "Bertola vindescenc"), ("m", "genusa00777x spec00777y"), ("n", None)], "id string, l string")
    for rows in (tied, tied + many):
        ref = spark.createDataFrame(rows, s)
        got = {x["key"]: x["entry"] for x in canonical_entries(r, F.col("id"), ["l"], ref).collect()}
        assert got == {"k": 0, "m": 777 if len(rows) > 2 else 0}
        within = {(x["entry"], x["distance"]) for x in entries_within(r, F.col("l"), ref).where("text like 'Bertola%'").collect()}
        assert within == {(1, 1), (30_000, 1)}


def test_positions_as_meant(spark):
    rows = [(1, 171.6, -44.3), (2, -44.3, 171.6), (3, 171.6, 44.3), (4, 0.0, 0.0), (5, None, -44.0), (6, float("nan"), -44.0), (7, 9999.0, -9999.0)]
    got = {r["i"]: (r["x_lon"], r["x_lat"]) for r in meant_position(spark.createDataFrame(rows, "i int, lon double, lat double")).collect()}
    assert got[1] == got[2] == got[3] == (171.6, -44.3) and all(got[i] == (None, None) for i in (4, 5, 6, 7))


def test_name_parts(spark):
    names = ["Alunia serrata 'Nana'", "alunia_serrata", "A. serrata", "Alunia sp.", "n/a", "", None, "Unknown", "Alunia × serrata (Voss) Lindk.", "serrata, Alunia", "Alúnia serrata"]
    got = [(r["x"]["genus"], r["x"]["epithet"]) for r in spark.createDataFrame([(n,) for n in names], "n string").select(name_parts(F.col("n")).alias("x")).collect()]
    full = ("alunia", "serrata")
    assert got == [full, full, ("a", "serrata"), ("alunia", None), (None, None), (None, None), (None, None), (None, None), full, full, full]


def points(spark, rows):
    return spark.createDataFrame(rows, "point_id long, source_slug string, scientific_name string, lon double, lat double").withColumn("id", F.lit("clash")).withColumn("src", F.lit("clash"))


def test_links_equal_brute_force(spark):
    rnd = np.random.default_rng(5)
    names = ["Alunia serrata", "A. serrata", "Bertola vindescens", None, "Alunia sp.", "bertola_vindescens"]
    rows = [(i, f"s{i % 3}", names[int(rnd.integers(6))], 171.6 + float(rnd.uniform(0, 4e-4)), -44.3 + float(rnd.uniform(0, 3e-4))) for i in range(150)]
    kind = {"Alunia serrata": "a", "A. serrata": "a", "Bertola vindescens": "b", "bertola_vindescens": "b"}
    got = {(r["point_id_a"], r["point_id_b"]) for r in link_points(points(spark, rows)).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] != b[1]:
                la, lb = np.radians(a[4]), np.radians(b[4])
                h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[3] - a[3]) / 2) ** 2
                ka, kb = kind.get(a[2]), kind.get(b[2])
                if 2 * 6371008.8 * np.arcsin(np.sqrt(h)) < 5 and (ka is None or kb is None or ka == kb):
                    want.add((a[0], b[0]))
    assert got == want and len(want) > 50


def test_pairs_come_once_and_edges(spark):
    rows = [(1, "a", None, 171.6, -44.3), (2, "b", None, 171.6, -44.3), (3, "a", None, 171.6, -44.3), (4, None, None, 171.6, -44.3), (5, "b", None, None, None)]
    classes, members = copy_classes(points(spark, rows), "point_id", "source_slug", "scientific_name")
    assert sorted((r["src"], r["n"]) for r in classes.collect()) == [("a", 2), ("b", 1)] and members.count() == 3
    p = candidate_pairs(classes)
    assert [r["n_pairs"] for r in p.collect()] == [2]
    got = link_points(points(spark, rows + rows[:1]))
    assert sorted((r[0], r[1]) for r in got.select("point_id_a", "point_id_b").collect()) == [(1, 2), (2, 3)]
    assert link_points(points(spark, [])).count() == 0
    assert agreement(p).where("l_name = 1 and l_dist = 0").agg(F.sum("n_pairs")).first()[0] == 2


def test_posterior_decides_where_names_do_not(spark):
    rows = [(1, "a", "Alunia serrata", 171.6, -44.3), (2, "b", "Alunia serrata", 171.6, -44.3), (3, "c", None, 171.6, -44.3)]
    got = lambda least: {(r[0], r[1]) for r in link_points(points(spark, rows), least_confidence=least).select("point_id_a", "point_id_b").collect()}
    assert got(0.0) == {(1, 2), (1, 3), (2, 3)} and got(1.1) == {(1, 2)}
    t = {(r["l_dist"], r["l_name"]): r for r in link_patterns(points(spark, rows)).collect()}
    assert len(t) == 15 and t[(0, 0)]["n_pairs"] == 1 and t[(0, 1)]["n_pairs"] == 2 and t[(0, 0)]["link"] and not t[(4, 0)]["link"]


def test_em_separates():
    post, share = em(np.array([[900, 40], [80, 60], [10, 900]], float), (3, 2))
    assert post[0, 0] > 0.95 and post[2, 1] < 0.05 and 0.3 < share < 0.7
