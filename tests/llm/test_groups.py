import random

import pytest
from pyspark.sql import functions as F

from grovekit.llm.components import connected_components, grouped_ids
from grovekit.llm.linkrows import HELPER, merge_edges
from grovekit.llm.survivors import fuse, instant, record_claims, record_votes, usable_value


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b string")


def groups(df):
    got = {}
    for r in df.collect():
        assert r["item"] not in got
        got[r["item"]] = r[1]
    return got


@pytest.mark.parametrize("seed,bound", [(1, 10_000), (2, 7), (3, 25)])
def test_components_equal_brute_force(spark, seed, bound):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randrange(150)}", f"n{rnd.randrange(150)}") for _ in range(120)]
    got = groups(grouped_ids(frame(spark, edges), partition_edges=bound))
    want = brute(edges)
    assert {k: v for k, v in got.items()} == {k: min(x for x in want if want[x] == want[k]) for k in want}


def test_long_chain_and_star_in_small_partitions(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("hub", f"s{i:03d}") for i in range(300)]
    rounds = []
    got = groups(grouped_ids(frame(spark, chain + star), partition_edges=60, rounds=rounds))
    assert rounds[0] == (600, 10) and len(rounds) > 2 and rounds[-1][1] == 1
    assert {got[x] for x in got if x[0] == "c"} == {"c0000"} and {got[x] for x in got if x[0] != "c"} == {"hub"}
    assert len(got) == 301 + 301


def test_degenerate_edges(spark):
    assert connected_components(frame(spark, [])).count() == 0
    got = groups(grouped_ids(frame(spark, [("a", None), (None, None), ("b", "b"), ("x", "y"), ("y", "x"), ("x", "y")])))
    assert got == {"x": "x", "y": "x"}


def test_merge_rows(spark):
    s = "cluster_id string, primary_tree_id string, member_tree_id string, created_at_utc timestamp, a string, b string"
    import datetime as dt

    t, u = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    rows = [
        ("1", " A ", "b\t", t, "", ""), ("1", None, "C", t, "", ""), ("1", "q", "r", u, "", ""),  # the same number in another run is another cluster
        (None, "x", "y", t, "", ""), ("2", None, "lone", t, "", ""), ("2", None, None, None, "", ""), ("9", "s", "s", u, "", ""),
    ]
    got = {r["item"]: r["group_id"] for r in grouped_ids(merge_edges(spark.createDataFrame(rows, s)), HELPER).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "q": "q", "r": "q", "x": "x", "y": "x"}


def test_usable_values_and_instants(spark):
    rows = [("N/A",), (" ",), (None,), (" Oak ",), ("tbc",), ("Not recorded",)]
    assert [r[0] for r in spark.createDataFrame(rows, "v string").select(usable_value(F.col("v"))).collect()] == [None, None, None, "Oak", None, None]
    t = spark.createDataFrame([("2024-01-01T12:00:00+12:00",), ("2024-01-01T00:00:00Z",), ("2024-01-01 00:00:00+00:00",), ("2024-01-01T00:00:00.000000+00:00",), ("soon",), (None,)], "v string")
    got = [r[0] for r in t.select(F.unix_seconds(instant(F.col("v")))).collect()]
    assert len(set(got[:4])) == 1 and got[4:] == [None, None]


def test_survivor_order_and_ties(spark):
    g = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("z", "y")], "tree_id string, group_tree_id string")
    rows = [("a", "x", 2, 5), ("b", "w", 1, 1), ("b", "w", 1, 1), ("c", "v", 1, 1), ("z", "n/a", 1, 1), (None, "u", 0, 0)]
    r = spark.createDataFrame(rows, "tree_id string, f string, k int, t int").withColumn("group_tree_id", F.lit("clash"))
    order = [F.col("k"), -F.col("t")]
    c = record_claims(r.withColumn("source", F.lit("s")), ["f"], [F.col("k"), F.col("t"), F.col("source")])
    got = fuse(record_votes(c, g, order))[0].collect()
    assert [(x["group_tree_id"], x["tree_id"], x["record_value"]) for x in got] == [("a", "b", "w")]
    for a, b in ((c.limit(0), g), (c, g.limit(0))):
        assert fuse(record_votes(a, b, order))[0].count() == 0
    assert sorted((x["group_tree_id"], x["value"], x["pattern"]) for x in record_votes(c, g, order).collect()) == [("a", "v", "s"), ("a", "w", "s"), ("a", "x", "s")]


def votes(spark, rows):
    """Votes of claims (group, field, value, source), each group's claims being one record's."""
    c = spark.createDataFrame(rows, "tree_id string, field_name string, value string, source string")
    return record_votes(c, c.select("tree_id", F.col("tree_id").alias("group_tree_id")).distinct(), [F.lit(0)])


def test_posterior_decides_between_equal_records(spark):
    rows = [("g", "f", "a", "s1"), ("g", "f", "b", "s2"), ("g", "f", "b", "s3")] + [(f"h{i}", "f", "x", s) for i in range(20) for s in ("s1", "s2", "s3")]
    got = {r["group_tree_id"]: r for r in fuse(votes(spark, rows))[0].collect()}
    assert got["g"]["record_value"] == got["g"]["value"] == "b" and got["g"]["record_posterior"] == got["g"]["posterior"]


def test_fusion_discounts_copies(spark):
    # s1 is right, s2 and s3 err independently, s4 and s5 copy the errors of s3
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        truth = "t"
        wrong = f"w{rnd.randrange(20)}"
        s3 = truth if rnd.random() < 0.45 else wrong
        rows += [(f"g{i}", "f", truth if rnd.random() < 0.9 else "e1", "s1"), (f"g{i}", "f", truth if rnd.random() < 0.85 else "e2", "s2")]
        rows += [(f"g{i}", "f", s3, s) for s in ("s3", "s4", "s5")]
    out, acc, copies, rounds = fuse(votes(spark, rows))
    got = out.collect()
    assert len(got) == 150 and sum(r["value"] == "t" for r in got) / 150 > 0.9 and rounds > 1
    assert copies[("s3", "s4")] > 0.9 and copies[("s4", "s5")] > 0.9 and copies.get(("s1", "s2"), 0) < 0.5
    assert acc["s1"] > acc["s3"] and all(0 < r["posterior"] <= 1 for r in got)


def test_fusion_edges(spark):
    got = fuse(votes(spark, [("g", "f", "b", None), ("g", "f", "a", None), ("g", "f", "a", None)]))[0].collect()
    assert [r["value"] for r in got] == ["a"]
    # more sources than fit an expression of all their pairs
    many = [("g", "f", "v" if i % 3 else "w", f"s{i:03d}") for i in range(150)]
    r = fuse(votes(spark, many))[0].first()
    assert r["value"] == "v" and r["n_sources"] == 100 and 0 < r["posterior"] <= 1
    # rounds that do not settle are told, and the records stand all the same
    with pytest.warns(UserWarning, match="still move"):
        out, _, _, rounds = fuse(votes(spark, [("g", "f", "a", "x"), ("g", "f", "a", "y"), ("h", "f", "b", "y")]), rounds_most=1)
    assert rounds == 1 and {(r["group_tree_id"], r["tree_id"]) for r in out.collect()} == {("g", "g"), ("h", "h")}
