"""Joins, aggregates, rankings and set operations that take any table by naming its columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.session import union_all

c = F.col


# joins
def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join in which a null key meets a null key; the keys of b are dropped."""
    right = b.select(*[c(k).alias(f"__r_{k}") for k in keys], *[x for x in b.columns if x not in keys])
    cond = None
    for k in keys:
        eq = a[k].eqNullSafe(right[f"__r_{k}"])
        cond = eq if cond is None else cond & eq
    return a.join(right, cond, how).drop(*[f"__r_{k}" for k in keys])


def star_join(fact: DataFrame, sides: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Left equi-joins of side tables, each unique in its key; a clashing side column gets the key's suffix order."""
    out, seen = fact, set(fact.columns)
    for i, (side, key) in enumerate(sides):
        ren = side.select(*[c(x).alias(x if x == key or x not in seen else f"{x}_{i + 1}") for x in side.columns])
        seen |= set(ren.columns)
        out = out.join(ren, key, "left")
    return out


def present_sides(tables: dict[str, DataFrame | None], keys: dict[str, str]) -> list[tuple[DataFrame, str]]:
    """The optional side tables that are there and hold their key."""
    return [(df, keys[n]) for n, df in tables.items() if df is not None and keys[n] in df.columns]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; nulls are a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"not unique in {list(keys)}: {bad[0].asDict()}")
    return df


def fallback_lookup(df: DataFrame, tries: Sequence[tuple[Column, DataFrame, str, str, str]], value: str, default: Column) -> DataFrame:
    """Value of the first look-up table that holds the key: (key expression, table, its key, its value, label).

    Look-up tables must be unique in their key; adds `value` and value_source ('model' for the default).
    """
    out = df
    got = []
    for i, (key, side, k, v, label) in enumerate(tries):
        small = side.select(c(k).alias(f"__k{i}"), c(v).alias(f"__v{i}"))
        out = out.withColumn(f"__q{i}", key).join(small, c(f"__q{i}") == c(f"__k{i}"), "left")
        got.append(F.when(c(f"__v{i}").isNotNull(), F.struct(c(f"__v{i}").alias("v"), F.lit(label).alias("s"))))
    best = F.coalesce(*got, F.struct(default.alias("v"), F.lit("model").alias("s")))
    return out.select(*df.columns, best.alias("__b")).select(*df.columns, c("__b.v").alias(value), c("__b.s").alias(f"{value}_source"))


def reconcile_signatures(old: DataFrame, new: DataFrame, sig: str, old_id: str, new_id: str) -> DataFrame:
    """(sig, old_id, new_id, state) between two versions: same, moved on (renumbered), ambiguous, gone, added.

    A signature held more than once on either side is ambiguous and gets no ids.
    """
    o = old.groupBy(sig).agg(F.count("*").alias("no"), F.min(old_id).alias("old_id"))
    n = new.groupBy(sig).agg(F.count("*").alias("nn"), F.min(new_id).alias("new_id"))
    j = o.join(n, sig, "full")
    state = (
        F.when(F.greatest(F.coalesce("no", F.lit(0)), F.coalesce("nn", F.lit(0))) > 1, "ambiguous")
        .when(c("nn").isNull(), "gone")
        .when(c("no").isNull(), "added")
        .when(c("old_id") == c("new_id"), "same")
        .otherwise("renumbered")
    )
    j = j.withColumn("state", state)
    return j.select(sig, F.when(c("state") != "ambiguous", c("old_id")).alias("old_id"), F.when(c("state") != "ambiguous", c("new_id")).alias("new_id"), "state")


# aggregates
def top_values(df: DataFrame, column: str, n: int, unknown: str = "Unknown") -> DataFrame:
    """The n commonest values and, first, the blank ones under `unknown`: (value, n, place)."""
    v = F.coalesce(F.nullif(F.btrim(c(column)), F.lit("")), F.lit(unknown))
    g = df.groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    known = g.where(c("value") != unknown).orderBy(c("n").desc(), "value").limit(n)
    w = Window.orderBy(c("n").desc(), "value")  # n rows
    return union_all([g.where(c("value") == unknown).select("value", "n", F.lit(0).alias("place")), known.select("value", "n", F.row_number().over(w).alias("place"))])


def quantile_probabilities(parts: int = 100, extra: Sequence[float] = (0.001, 0.999)) -> list[float]:
    return sorted({i / parts for i in range(parts + 1)} | set(extra))


def quantile_table(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], small: int = 60) -> DataFrame:
    """(keys, n, q, exact): linear quantiles at the probabilities; groups of at most `small` rows give their sorted
    values instead. Null values are left out. The quantiles are a mergeable aggregate of value counts."""
    d = df.where(c(value).isNotNull())
    big = d.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, F.array(*[F.lit(float(p)) for p in probabilities])).alias("q"))
    sizes = big.where(c("n") <= small).select(*keys)
    exact = null_safe_join(d, sizes, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(c(value).cast("double"))).alias("exact"))
    return null_safe_join(big, exact, keys, "left").select(*keys, "n", F.when(c("n") > small, c("q")).alias("q"), "exact")


def keyed_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Count of each value in a fixed order, 0 where it does not occur."""
    return df.groupBy(*keys).agg(*[F.count(F.when(c(column) == v, 1)).alias(f"n_{v}".replace(" ", "_")) for v in values])


def members_json(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """JSON array of the group's members in a stated order; nulls inside a member are left out."""
    s = F.struct(*[c(o).alias(f"__{o}") for o in order], *fields)
    arr = F.transform(F.sort_array(F.collect_list(s)), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return df.groupBy(*keys).agg(F.to_json(arr).alias("members"), F.count("*").alias("n"))


def diversity(df: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Shannon and Simpson diversity per key from a two-level count; null kinds are left out."""
    n = df.where(c(kind).isNotNull()).groupBy(*keys, kind).agg(F.count("*").alias("__k"))
    t = n.groupBy(*keys).agg(F.sum("__k").alias("__n"), F.count("*").alias("n_kinds"), F.sum(c("__k") * F.ln("__k")).alias("__a"), F.sum(c("__k") * c("__k")).alias("__b"))
    return t.select(*keys, c("__n").alias("n"), "n_kinds", (F.ln("__n") - c("__a") / c("__n")).alias("shannon"), (1 - c("__b") / (c("__n") * c("__n"))).alias("simpson"))


def error_summary(df: DataFrame, keys: Sequence[str], truth: Column, guess: Column, least: int = 30) -> DataFrame:
    """RMSE, MAE, bias and Pearson r per band of at least `least` rows."""
    d = guess - truth
    # null where either side is constant, which corr() answers with an error under ANSI rules
    r = F.covar_pop(truth, guess) / F.nullif(F.stddev_pop(truth) * F.stddev_pop(guess), F.lit(0.0))
    g = df.groupBy(*keys).agg(F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), r.alias("r"))
    return g.where(c("n") >= least)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(lo, hi): score interval of a share; null for no trials."""
    n1 = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n1
    mid = (p + z * z / (n1 * 2)) / (F.lit(1.0) + z * z / n1)
    half = F.sqrt(p * (1 - p) / n1 + z * z / (n1 * n1 * 4)) * z / (F.lit(1.0) + z * z / n1)
    told = lambda v: F.when(n1.isNotNull(), v)
    return F.struct(told(F.greatest(mid - half, F.lit(0.0))).alias("lo"), told(F.least(mid + half, F.lit(1.0))).alias("hi"))


def cohort_quantiles(df: DataFrame, band: str, value: str, probabilities: Sequence[float], least: int = 50) -> DataFrame:
    """Quantiles per band, those of all rows where a band has fewer than `least`: (band, n, q, from_all)."""
    p = F.array(*[F.lit(float(x)) for x in probabilities])
    g = df.groupBy(band).agg(F.count(value).alias("n"), F.percentile(value, p).alias("q"))
    every = df.agg(F.percentile(value, p).alias("qa")).scalar()
    return g.select(band, "n", F.when(c("n") >= least, c("q")).otherwise(every).alias("q"), (c("n") < least).alias("from_all"))


def robust_spread(df: DataFrame, key: str, value: str, floor: float = 0.15, least: int = 15) -> DataFrame:
    """(key, n, centre, spread): median and 1.4826 times the median deviation, not below `floor`."""
    m = df.groupBy(key).agg(F.count(value).alias("n"), F.median(value).alias("centre")).where(c("n") >= least)
    d = df.join(m, key).groupBy(key).agg(F.first("n").alias("n"), F.first("centre").alias("centre"), F.median(F.abs(c(value) - c("centre"))).alias("mad"))
    return d.select(key, "n", "centre", F.greatest(c("mad") * 1.4826, F.lit(floor)).alias("spread"))


def _place_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key and value: rows, and rows up to and with it. A window over distinct values, not over rows."""
    n = df.where(c(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys).orderBy(value)
    return n.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy(*keys)))


def value_at(df: DataFrame, keys: Sequence[str], value: str, place: Column) -> DataFrame:
    """(keys, n, v): the value at a place (1 is the smallest) that may depend on n, such as n div 2 + 1."""
    p = _place_counts(df, keys, value).withColumn("place", place)
    hit = p.where((c("place") <= c("upto")) & (c("place") > c("upto") - c("k")))
    return hit.select(*keys, "n", c(value).alias("v"))


def exclusive_quantile(df: DataFrame, keys: Sequence[str], value: str, part: float) -> DataFrame:
    """(keys, n, v): quantile at part * (n + 1), between neighbours linearly; places outside keep the end values."""
    p = _place_counts(df, keys, value).withColumn("h", F.lit(part) * (c("n") + 1))
    lo = F.least(F.greatest(F.floor("h"), F.lit(1)), F.greatest(c("n") - 1, F.lit(1)))
    p = p.withColumn("lo", lo).withColumn("frac", F.when(c("n") > 1, c("h") - c("lo")).otherwise(0.0))
    at = lambda place: F.max(F.when((place <= c("upto")) & (place > c("upto") - c("k")), c(value)))
    g = p.groupBy(*keys).agg(F.max("n").alias("n"), F.max("frac").alias("f"), at(c("lo")).alias("a"), at(F.least(c("lo") + 1, c("n"))).alias("b"))
    return g.select(*keys, "n", (c("a") + (c("b") - c("a")) * c("f")).alias("v"))


def percentile_in(v: Column, q: Column, p: Column) -> Column:
    """Percent of a value in a published quantile vector q at probabilities p: linear between knots, the middle of
    the probabilities of equal knots, 0 below and 100 above."""
    pairs = F.arrays_zip(q.alias("q"), p.alias("p"))
    same = F.transform(F.filter(pairs, lambda x: x["q"] == v), lambda x: x["p"])
    below = F.filter(pairs, lambda x: x["q"] < v)
    above = F.filter(pairs, lambda x: x["q"] > v)
    a, b = F.element_at(below, -1), F.element_at(above, 1)
    line = a["p"] + (b["p"] - a["p"]) * (v - a["q"]) / (b["q"] - a["q"])
    return F.when(v.isNull(), None).when(F.size(same) > 0, (F.array_min(same) + F.array_max(same)) * 50).when(F.size(below) == 0, 0.0).when(F.size(above) == 0, 100.0).otherwise(line * 100)


def mid_rank(v: Column, values: Column) -> Column:
    """Share of values below plus half of those equal."""
    less = F.size(F.filter(values, lambda x: x < v))
    same = F.size(F.filter(values, lambda x: x == v))
    return (less + same / 2) / F.nullif(F.size(values).cast("double"), F.lit(0.0))


def stratified_sample(df: DataFrame, strata: Sequence[str], caps: dict[str, int] | int, key: str, seed: int = 1) -> DataFrame:
    """Rows of each stratum with the lowest seeded hash, as many as its cap (a cap per value of the first stratum column or one for all)."""
    if isinstance(caps, int):
        cap = F.lit(caps)
    else:
        cap = F.lit(0)
        for k, v in caps.items():
            cap = F.when(c(strata[0]) == k, v).otherwise(cap)
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(c(key), F.lit(seed)), key)
    most = caps if isinstance(caps, int) else max(caps.values(), default=0)
    return df.withColumn("__r", F.row_number().over(w)).where(c("__r") <= most).where(c("__r") <= cap).drop("__r")


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """n rows of each group, evenly spaced in its order and with both ends; all rows of smaller groups."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("__r", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    # place i is round(i * (N - 1) / (n - 1)): a row stays if some i gives it
    i = F.round(c("__r") * (n - 1) / F.greatest(c("__n") - 1, F.lit(1)))
    hit = F.floor(i * (c("__n") - 1) / (n - 1) + 0.5) == c("__r")
    return x.where((c("__n") <= n) | hit).drop("__r", "__n")


def block_bootstrap(df: DataFrame, block: str, value: str, rounds: int = 200, seed: int = 1) -> DataFrame:
    """(n_blocks, mean, lo, hi): interval of the mean by Poisson resampling of whole blocks.

    Each block gets a Poisson(1) weight per round from its hash, so all rounds are one pass over the block sums.
    """
    b = df.groupBy(c(block).alias("__b")).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    r = b.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    u = (F.pmod(F.xxhash64("__b", c("round"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cut, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        cut.append(total)
        term /= k + 1
    weight = F.lit(8)
    for k in reversed(range(8)):
        weight = F.when(u < cut[k], k).otherwise(weight)
    # round 0 is the plain mean
    w = F.when(c("round") == 0, 1).otherwise(weight)
    m = r.groupBy("round").agg((F.sum(w * c("__s")) / F.nullif(F.sum(w * c("__n")).cast("double"), F.lit(0.0))).alias("m"), F.count("*").alias("k"))
    return m.agg(F.max("k").alias("n_blocks"), F.max(F.when(c("round") == 0, c("m"))).alias("mean"), F.percentile(F.when(c("round") > 0, c("m")), 0.025).alias("lo"), F.percentile(F.when(c("round") > 0, c("m")), 0.975).alias("hi"))


# rankings
def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tag: str | None = None) -> DataFrame:
    """First row of each key in an order; the rank is cut before the shuffle, so hot keys are no burden."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(w))
    return out.where(c("__r") == 1).drop("__r")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def winners_losers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], id_col: str) -> DataFrame:
    """(keys, winner, loser) for keys held by several rows."""
    r = df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n > 1").withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    win = r.where("__r = 1").select(*keys, c(id_col).alias("winner"))
    return r.where("__r > 1").select(*keys, c(id_col).alias("loser")).join(win, list(keys)).select(*keys, "winner", "loser")


def softmax_ranks(df: DataFrame, keys: Sequence[str], score: str, tie: str, top: int = 3) -> DataFrame:
    """Rank, share by softmax, and the margin to the second of the options of a key; the first `top` come out."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(c(score).desc(), tie)
    x = df.withColumn("__m", F.max(score).over(w)).withColumn("__e", F.exp(c(score) - c("__m")))
    x = x.withColumn("p_local", c("__e") / F.sum("__e").over(w)).withColumn("rank", F.row_number().over(o)).withColumn("margin", c(score) - F.lead(score).over(o))
    return x.where(c("rank") <= top).drop("__m", "__e")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, most: int | None = None) -> DataFrame:
    """Numbers unbroken runs of a key's ordered rows (island), cuts them into pieces of at most `most` rows (piece)
    and counts the place in the run. `breaks` tells, with F.lag over `run_window`, where a new run starts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("__b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("island", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order)))
    return x.withColumn("piece", F.ceil(c("place") / (most or 1 << 30)).cast("int")).drop("__b")


def leaders(df: DataFrame, keys: Sequence[str], value: str, id_col: str, margin: float) -> DataFrame:
    """(keys, leader, value, next, margin, within_margin) of the largest value per key."""
    w = Window.partitionBy(*keys).orderBy(c(value).desc(), id_col)
    x = df.where(c(value).isNotNull()).withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    g = x.groupBy(*keys).agg(F.max(F.when(c("rank") == 1, c(id_col))).alias("leader"), F.max(F.when(c("rank") == 1, c(value))).alias("value"), F.max(F.when(c("rank") == 2, c(value))).alias("next"))
    return g.select(*keys, "leader", "value", "next", (c("value") - c("next")).alias("margin"), F.coalesce(c("value") - c("next") < margin, F.lit(False)).alias("within_margin"))


def deficit_splits(blocks: list[tuple[str, int]], shares: dict[str, float]) -> dict[str, str]:
    """Blocks, largest first, each to the split that lacks most of its target; for a short list of blocks."""
    total = sum(n for _, n in blocks)
    have = {k: 0 for k in shares}
    out = {}
    for b, n in sorted(blocks, key=lambda x: (-x[1], x[0])):
        best = max(shares, key=lambda k: ((shares[k] * total - have[k]) / max(shares[k] * total, 1.0), k))
        out[b] = best
        have[best] += n
    return out


# sets
def union_versions(current: DataFrame, legacy: DataFrame, flag: str = "is_current") -> DataFrame:
    """Current rows and older ones, columns that one side lacks as null."""
    return current.withColumn(flag, F.lit(1)).unionByName(legacy.withColumn(flag, F.lit(0)), allowMissingColumns=True)


def except_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of only one side, with the side's name."""
    return union_all([a.subtract(b).withColumn("only_in", F.lit("a")), b.subtract(a).withColumn("only_in", F.lit("b"))])


def upsert(base: DataFrame, changes: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """Rows of both with one row per key: those of `changes` win (replace) or lose (ignore)."""
    first, second = (changes, base) if replace else (base, changes)
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def replace_slices(base: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Base without the slices (values of a column) that `new` holds, and `new`."""
    return base.join(new.select(column).distinct(), column, "left_anti").select(*base.columns).unionByName(new)


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table that has the key without the given ids."""
    return {n: t.join(ids.select(key).distinct(), key, "left_anti") if key in t.columns else t for n, t in tables.items()}


# rules
def cascade(rules: Sequence[tuple[Column, str, str]], default: tuple[str | None, str]) -> Column:
    """struct(value, basis) of the first rule whose condition is true."""
    out = None
    for cond, value, basis in rules:
        s = F.struct(F.lit(value).alias("value"), F.lit(basis).alias("basis"))
        out = F.when(cond, s) if out is None else out.when(cond, s)
    last = F.struct(F.lit(default[0]).cast("string").alias("value"), F.lit(default[1]).alias("basis"))
    return last if out is None else out.otherwise(last)


def reasons(flags: Sequence[tuple[Column, str]], sep: str = "; ") -> Column:
    """Names of the true flags in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for x, n in flags])), sep)
