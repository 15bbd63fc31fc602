import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.llm.leakage import Item, ItemIndex, find_leaks, leaked_items, normal_words
from grovekit.llm.mixing import mix, plain_source
from grovekit.llm.splitting import boundaries, split_documents, split_text
from grovekit.llm.tokens import encoder

WORDS = [f"{a}{b}" for a in ("bar", "lon", "mist", "ker", "vond", "sal", "trim", "gol", "pef", "hun") for b in ("ding", "ora", "ette", "ium", "ash", "elow", "ith", "um", "arc", "ean")]


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(1)
    return [(i, text(rnd, 30 + i)) for i in range(20)]


def test_leaks_in_disguise(items):
    ix = ItemIndex(items)
    rnd = random.Random(2)
    w = items[7][1].split()
    pad = lambda: text(rnd, 80)
    typo = list(w)
    typo[3], typo[15] = typo[3][:-1] + "x", "q" + typo[15]
    cases = {
        "whole": " ".join(w), "case": " ".join(w).upper(), "markup": " ".join(f"<b>{x}</b>" if i % 4 == 0 else f"**{x}**" for i, x in enumerate(w)),
        "lines": "\r\n".join(w), "punctuation": ", ".join(w), "typos": " ".join(typo), "half": " ".join(w[5 : 5 + len(w) // 2 + 2]), "hyphen": " ".join(w[:10]) + " " + w[10][:3] + "-\n" + w[10][3:] + " " + " ".join(w[11:]),
    }
    for name, t in cases.items():
        assert 7 in [i for i, _, _ in find_leaks(ix, normal_words(f"{pad()} {t} {pad()}"))], name
    for t in (" ".join(w[: len(w) // 2 - 3]), " ".join(w[::2]), " ".join(sorted(w)), pad(), "", "a"):
        assert 7 not in [i for i, _, _ in find_leaks(ix, normal_words(f"{pad()} {t}"))]


def test_half_with_a_mistyped_word_in_every_third_place(items):
    ix = ItemIndex(items)
    rnd = random.Random(21)
    for i, t in items:
        w = t.split()
        need = -(-len(w) // 2) + 1
        for start in (0, (len(w) - need) // 2, len(w) - need):
            for first in range(3):
                part = w[start : start + need]
                part[first::3] = [x[:-1] + "q" for x in part[first::3]]
                doc = f"{text(rnd, 60)} {' '.join(part)} {text(rnd, 60)}"
                hit = [s for k, s, _ in find_leaks(ix, normal_words(doc)) if k == i]
                # a mistyped word at the rim of a stretch cannot be told from the text around it
                assert hit or first != 1, (i, start, first)


def test_retrieval_equals_exhaustive_scores(items):
    ix = ItemIndex(items)
    rnd = random.Random(3)
    import numpy as np

    for _ in range(30):
        t = text(rnd, 40) + " " + " ".join(rnd.choice(items)[1].split()[:25])
        terms = np.array(sorted({ix.term[w] for w in normal_words(t) if w in ix.term}))
        score = ix.impacts[ix.place[terms]].sum(axis=0).ravel()[: len(ix.items)]
        assert {i for i, _ in ix.retrieve(terms)} == {int(i) for i in np.flatnonzero(score >= 1)}


def test_leak_table_edges(spark, items):
    rnd = random.Random(5)
    docs = [(1, items[3][1]), (2, None), (3, ""), (4, text(rnd, 60_000) + " " + items[9][1]), (1, items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame([*items, (99, None), (98, ""), (items[3][0], items[3][1])], "item_id long, text string").withColumn("doc_id", F.lit(5))
    assert len(leaked_items(d, i, index_items=6).collect()) == 2
    got = leaked_items(d, i).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (4, 9)]
    assert sorted(map(tuple, leaked_items(d, i, items_at_once=6).select("doc_id", "item_id").collect())) == [(1, 3), (4, 9)]
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


def test_item_units_are_written_words():
    it = Item(1, "Flood-prone  plots, 2.17 each")
    assert it.n_units == 4 and it.words == ["flood", "prone", "plots", "2", "17", "each"]


def test_split_round_trip():
    rnd = random.Random(6)
    enc, _ = encoder()
    prose = "\n\n".join(". ".join(text(rnd, 12) for _ in range(8)) + "." for _ in range(40))
    for t in (prose, prose.replace("\n\n", " "), "".join(rnd.choice("abcdefghijkāū漢😀") for _ in range(9000)), "a" * 30_000, "\r\n".join(text(rnd, 5) for _ in range(900)), "x \n" * 4000):
        got = split_text(t)
        n = len(enc.encode_ordinary(t))
        assert bool(got) == (n > 2048)
        if not got:
            continue
        assert all(len(enc.encode_ordinary(p)) == k <= 2048 for p, k, *_ in got) and all(t[a:b] == p for p, _, _, a, b in got)
        assert got[0][3] == 0 and got[-1][4] == len(t) and all(b[3] < a[4] < b[4] for a, b in zip(got, got[1:]))
        assert all(60 <= x[2] <= 70 for x in got[1:])
    got = split_text(prose)
    assert all(prose[x[4] - 2 : x[4]] == "\n\n" for x in got[:-1])


def test_sentence_ends_are_characters_not_bytes():
    enc, size = encoder()

    def cuts(t):
        ids = enc.encode_ordinary(t)
        at = np.cumsum(size[np.array(ids)])
        return {len(t.encode()[: int(e)].decode(errors="ignore")) for e, s in zip(at, boundaries(t.encode(), at)) if s == 2}

    # the last bytes of these words are those of the ideographic full stop
    assert cuts("тр тт ти яр пт") == set() and cuts("слово р. ещё") != set()
    assert cuts("森林。木") == {3}


def test_pieces_never_exceed_the_limit():
    rnd = random.Random(12)
    enc, _ = encoder()
    for limit, overlap in ((8, 3), (16, 8), (64, 60), (5, 0)):
        for t in ("".join(rnd.choice("aж漢😀é ") for _ in range(400)), "x" * 500, "слово " * 90, "." * 300, "😀" * 60):
            try:
                got = split_text(t, limit, overlap)
            except ValueError:
                assert limit - overlap <= 5  # a character of several tokens beside its overlap
                continue
            if not got:
                assert len(enc.encode_ordinary(t)) <= limit
                continue
            assert got[0][3] == 0 and got[-1][4] == len(t) and all(b[3] <= a[4] < b[4] for a, b in zip(got, got[1:]))
            assert all(len(enc.encode_ordinary(p)) == n <= limit and t[a:z] == p for p, n, _, a, z in got)
    with pytest.raises(ValueError):
        split_text("word " * 50, 8, 8)


def test_split_table_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "word " * 3000), (None, "word " * 3000)], "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = split_documents(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_pieces").alias("m")).collect()
    assert sorted((r["doc_id"] or 0, r["n"] == r["m"]) for r in got) == [(0, True), (4, True)]
    assert split_documents(d.limit(0)).count() == 0


def test_mix_reaches_targets(spark):
    rnd = random.Random(8)
    rows = [(i, ["big", "Mid-one", "small", None, "other"][0 if i % 3 else i % 5], text(rnd, rnd.randrange(5, 40))) for i in range(3000)] + [(9001, "big", None), (9002, "big", "")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit(-5)).withColumn("copies", F.lit(0))
    t = spark.createDataFrame([("big", 0.5, 1), ("mid_one", 0.2, 3), ("small", 0.25, 4), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    exact = mix(d, t)[1].first()["largest_exact_total"]
    chosen, report = mix(d, t, total_tokens=int(exact))
    r = {x["source"]: x for x in report.collect()}
    assert r["absent"]["tokens_used"] == 0 and r["absent"]["share_reached"] == 0 and r["absent"]["short_tokens"] == r["absent"]["tokens_aimed"]
    longest = chosen.agg(F.max("n_tokens")).first()[0]
    for s in ("big", "mid_one", "small"):
        assert abs(r[s]["tokens_used"] - r[s]["tokens_aimed"]) <= longest and r[s]["most_copies"] <= r[s]["max_repeats"]
    assert min(r[s]["max_repeats"] * r[s]["tokens_there"] - r[s]["tokens_used"] for s in ("big", "mid_one", "small")) <= longest
    got = chosen.collect()
    assert len({x["doc_id"] for x in got}) == len(got)
    again = {(x["doc_id"], x["copies"]) for x in mix(d.repartition(5), t, total_tokens=int(exact))[0].collect()}
    assert again == {(x["doc_id"], x["copies"]) for x in got}  # the choice does not hang on the layout
    chosen, report = mix(d.limit(0), t)
    assert chosen.count() == 0 and {x["tokens_used"] for x in report.collect()} == {0}


def test_mix_prefix_sum_is_exact(spark):
    rows = [(i, "a", "word " * (1 + i % 7)) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 5)], "source string, target_share double, max_repeats int")
    total = 700
    chosen, report = mix(d, t, total_tokens=total)
    used = report.first()["tokens_used"]
    assert abs(used - total) <= 8
    every = mix(d, t, fraction=5.0)[0].collect()
    assert len(every) == 500 and {x["copies"] for x in every} == {5}


def test_scarce_source_does_not_set_the_total(spark):
    rows = [(i, "rare" if i < 3 else "common", "word " * 10) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    t = spark.createDataFrame([("Rare", 0.5, 2), ("common", 0.5, 1), ("common", 0.5, 1), (None, 0.3, 1), ("none", None, None)], "source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in mix(d, t, fraction=0.5)[1].collect()}
    there = r["rare"]["tokens_there"] + r["common"]["tokens_there"]
    assert set(r) == {"rare", "common", "none"} and r["none"]["tokens_used"] == 0
    assert r["rare"]["tokens_used"] == 2 * r["rare"]["tokens_there"] and r["rare"]["most_copies"] == 2
    assert r["rare"]["short_tokens"] == pytest.approx(there / 4 - r["rare"]["tokens_used"])
    assert abs(r["common"]["tokens_used"] - there / 4) <= 11 and r["common"]["short_tokens"] == 0
    assert sum(x["share_reached"] for x in r.values()) == pytest.approx(1)
    # the total is linear in the input, whatever the scarcest source holds
    twice = d.unionByName(d.where("source = 'common'").withColumn("doc_id", F.col("doc_id") + 1000))
    more = {x["source"]: x for x in mix(twice, t, fraction=0.5)[1].collect()}
    assert more["common"]["tokens_aimed"] / r["common"]["tokens_aimed"] == pytest.approx((there + r["common"]["tokens_there"]) / there)


def test_plain_source(spark):
    got = spark.createDataFrame([("Survey Logs",), ("survey-logs",), (" SURVEY_LOGS ",), (None,)], "s string").select(plain_source(F.col("s"))).collect()
    assert [r[0] for r in got] == ["survey_logs"] * 3 + [None]
