"""The best representative of each duplicate group.

Bayesian fusion with copy detection: the sources' accuracies and their dependence are estimated from shared true and
false values, copied votes are discounted, and per group and field the value of maximum posterior is taken, beside
the record that a stated precedence puts first (the posterior decides between records that it leaves equal).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.session import bounded_collect, cut

#: words that stand for a missing value (fixed values)
MISSING = ["", "-", "?", "n/a", "na", "nil", "none", "null", "not recorded", "tba", "tbc", "unidentified", "unk", "unknown", "<blank>"]
SOURCES_MOST = 200
FALSE_VALUES = 20
COPY_SHARE = 0.8
COPY_PRIOR = 0.1
ROUNDS_MOST, SETTLED = 60, 1e-2
#: a score beyond this is a posterior of 1 in double precision
SCORE_MOST = 600.0
#: joins the sorted names of the sources that vote alike
BETWEEN = "\x1f"


def usable_value(c: Column) -> Column:
    """The trimmed value, null where it is blank or a word for missing."""
    t = F.btrim(c, F.lit(" \t\r\n "))
    return F.when(~F.lower(t).isin(MISSING), t)


def instant(c: Column) -> Column:
    """Instant of ISO text however it is spelled; null where it cannot be read. Text without zone is UTC."""
    return F.try_to_timestamp(F.btrim(c))


def record_claims(records: DataFrame, fields: list[str], keep: list[Column]) -> DataFrame:
    """(tree_id, field_name, value, *keep): one row per record and usable field; records without id give none."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), usable_value(F.col(f)).alias("value")) for f in fields])
    mine = records.where(F.col("tree_id").isNotNull()).select(F.col("tree_id").alias("__t"), *keep, F.explode(pairs).alias("__f")).where(F.col("__f.value").isNotNull())
    kept = [x for x in mine.columns if x not in ("__t", "__f")]
    return mine.select(F.col("__t").alias("tree_id"), "__f.field_name", "__f.value", *kept)


def record_votes(claims: DataFrame, groups: DataFrame, order: list[Column], source: str = "source") -> DataFrame:
    """(group_tree_id, field_name, value, pattern, best): the values claimed in each group, the sorted sources that
    claim them as one string, and the first record in `order`, then by tree id, that does.

    The claims of a record are combined before the groups are joined, and both steps are aggregates with map-side
    combining, so neither a record delivered without end nor a huge group meets in one task. Members without a
    record and records in no group give no row; a null source is a source of its own; an empty side gives none.
    """
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    name = F.coalesce(F.col(source), F.lit("(none)"))
    own = claims.groupBy("tree_id", "field_name", "value", name.alias("s")).agg(F.min(rank).alias("r"))
    mine = own.join(groups.select("tree_id", "group_tree_id"), "tree_id")
    v = mine.groupBy("group_tree_id", "field_name", "value").agg(F.array_join(F.sort_array(F.collect_set("s")), BETWEEN).alias("pattern"), F.min(F.struct("r", "tree_id")).alias("best"))
    return v


def _scorer(accuracy: dict[str, float], copies: dict[tuple[str, str], float]):
    """pattern -> log odds of its sources, each vote discounted by the chance that it was copied from a more accurate
    source that votes alike."""
    place = {s: i for i, s in enumerate(sorted(accuracy, key=lambda s: (-accuracy[s], s)))}

    @lru_cache(100_000)
    def score(pattern: str) -> float:
        names, total = sorted(pattern.split(BETWEEN), key=place.get), 0.0
        for i, s in enumerate(names):
            w = math.log(FALSE_VALUES * accuracy[s] / (1 - accuracy[s]))
            for t in names[:i]:
                w *= 1 - COPY_SHARE * copies.get((min(s, t), max(s, t)), 0.0)
            total += w
        return total

    return score


def _tally(accuracy: dict[str, float] | None, copies: dict[tuple[str, str], float]):
    """Per partition of signatures: for each pair of sources (a source with itself: its own votes) how often they vote
    alike, weighted by the belief in the value and in its falsehood, and how often both vote at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scorer(accuracy, copies) if accuracy else None
        sums: dict[tuple[str, str], np.ndarray] = {}

        def add(names: list[str], true: float, false: float, met: float) -> None:
            for pair in [*combinations(names, 2), *((s, s) for s in names)]:
                sums.setdefault(pair, np.zeros(3))
                sums[pair] += (true, false, met)

        for pdf in batches:
            for sig, k in zip(pdf["sig"], pdf["k"]):
                n = np.array([v["n"] for v in sig], dtype=float)
                if score is None:
                    p = np.ones(len(sig))
                else:
                    z = np.array([score(v["pattern"]) for v in sig])
                    top = max(z.max(), 0.0)
                    e = np.exp(z - top)
                    p = e / ((n * e).sum() + max(FALSE_VALUES + 1 - n.sum(), 0) * math.exp(-top))
                for v, m, q in zip(sig, n, p):
                    add(v["pattern"].split(BETWEEN), k * m * q, k * m * (1 - q), 0.0)
                add(sorted({s for v in sig for s in v["pattern"].split(BETWEEN)}), 0.0, 0.0, float(k))
        yield pd.DataFrame([(a, b, *x.tolist()) for (a, b), x in sums.items()], columns=["a", "b", "t", "f", "met"])

    return run


def _dependence(seen: dict[tuple[str, str], tuple], accuracy: dict[str, float], believed: bool = True) -> dict[tuple[str, str], float]:
    """Probability that two sources depend, from how often they share true values, share false ones, or differ;
    where nothing is believed yet, from how often they agree or differ."""
    out = {}
    for (a, b), (kt, kf, met) in seen.items():
        if a == b or kt + kf == 0:
            continue
        kd = max(0.0, met - kt - kf)
        acc = (accuracy[a] + accuracy[b]) / 2
        e = 1 - acc
        pt, pf = acc * acc, e * e / FALSE_VALUES
        pd_ = max(1e-9, 1 - pt - pf)
        if not believed:
            pt = pt + pf * FALSE_VALUES
            pd_ = max(1e-9, 1 - pt)
        dt, df = COPY_SHARE * (acc if believed else 1.0) + (1 - COPY_SHARE) * pt, COPY_SHARE * e + (1 - COPY_SHARE) * pf
        dd = max(1e-9, (1 - COPY_SHARE) * pd_)
        lr = kt * math.log(pt / dt) + kf * math.log(pf / df) + kd * math.log(pd_ / dd) + math.log((1 - COPY_PRIOR) / COPY_PRIOR)
        out[(a, b)] = 1 / (1 + math.exp(min(50.0, max(-50.0, lr))))
    return out


def fuse(votes: DataFrame, rounds_most: int = ROUNDS_MOST) -> tuple[DataFrame, dict[str, float], dict[tuple[str, str], float], int]:
    """Bayesian fusion with copy detection of votes (group_tree_id, field_name, value, pattern, best).

    Returns (group_tree_id, field_name, value, posterior, n_sources, tree_id, record_value, record_posterior), the
    sources' accuracies, the probability of dependence per pair of sources, and the rounds taken. value is that of
    maximum posterior, ties to the smallest; tree_id and record_value are of the record that precedence puts first,
    and of its values the more probable one.

    A score hangs on the set of sources alone, so the rounds run over the distinct signatures (what sets vote for a
    field's values, and how often) instead of the votes, and only sums per pair of at most SOURCES_MOST sources reach
    the driver. They end when no accuracy and no dependence moves by more than SETTLED; after
    rounds_most rounds it goes on with what it has and warns.
    """
    obj = ["group_tree_id", "field_name"]
    votes = cut(votes)
    names = F.explode(F.split("pattern", BETWEEN)).alias("s")
    accuracy = {r[0]: 0.8 for r in bounded_collect(votes.select("pattern").distinct().select(names).distinct(), SOURCES_MOST, "sources")}
    sig = votes.groupBy(*obj, "pattern").agg(F.count("*").alias("n")).groupBy(*obj).agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("sig"))
    sig = cut(sig.groupBy("sig").agg(F.count("*").alias("k")))

    def tally(a: dict | None) -> dict[tuple[str, str], tuple]:
        got = sig.mapInPandas(_tally(a, copies), "a string, b string, t double, f double, met double")
        return {(r["a"], r["b"]): (r["t"], r["f"], r["met"]) for r in got.groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in ("t", "f", "met")]).collect()}  # a row a pair

    copies: dict[tuple[str, str], float] = {}
    taken = 0
    if accuracy:
        # before any value is believed, two sources are compared by how often they agree
        copies = _dependence(tally(None), accuracy, believed=False)
        while True:
            taken += 1
            seen = tally(accuracy)
            new = {s: min(0.99, max(0.05, seen[(s, s)][0] / max(1e-9, seen[(s, s)][0] + seen[(s, s)][1]))) for s in accuracy}
            more = _dependence(seen, new)
            moved = max([abs(new[s] - accuracy[s]) for s in new] + [abs(more.get(x, 0.0) - copies.get(x, 0.0)) for x in {*more, *copies}])
            accuracy, copies = new, more
            if moved <= SETTLED:
                break
            if taken >= rounds_most:
                warnings.warn(f"accuracies still move by {moved:.3f} after {taken} rounds", stacklevel=2)
                break

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _scorer(accuracy, copies)
        for s in batches:
            yield s.map(one).astype(float)

    v = votes.withColumn("score", score("pattern"))
    down = (-F.col("score")).alias("m")
    g = v.groupBy(*obj).agg(
        F.sum(F.exp(F.least(F.col("score"), F.lit(SCORE_MOST)))).alias("z"),
        F.count("*").alias("n"),
        F.min(F.struct(down, "value", F.size(F.split("pattern", BETWEEN)).alias("n"))).alias("b"),
        F.min(F.struct("best", down, "value")).alias("r"),
    )
    z = F.col("z") + F.greatest(F.lit(FALSE_VALUES + 1) - F.col("n"), F.lit(0))
    chance = lambda x: F.exp(F.least(-F.col(x), F.lit(SCORE_MOST))) / z
    out = g.select(*obj, "b.value", chance("b.m").alias("posterior"), F.col("b.n").alias("n_sources"), "r.best.tree_id", F.col("r.value").alias("record_value"), chance("r.m").alias("record_posterior"))
    return out, accuracy, copies, taken
