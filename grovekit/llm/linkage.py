"""Matching records of the same thing across sources without a common key.

Multi-pass blocking (own cell, and the cells to the east, north and north-east that lie in reach), agreement levels
of position and name, expectation maximisation over the counts of level patterns, the posterior as confidence.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.operators.proximity import EARTH_M, metres, usable
from grovekit.session import cut

REACH_M = 5.0
#: fixed values: the country's box, in which a position as meant must lie
BOX = (160.0, -180.0, -55.0, -25.0)
#: fixed values: words in place of an epithet, and names that tell nothing
NO_EPITHET = ["sp", "spp", "species", "indet", "unknown", "unclear", "hybrid", "hort", "cultivar"]
NO_NAME = ["unknown", "unidentified", "none", "nil", "null", "na", "n a", "tba", "tbc", "not recorded", "not", "tree", "other", "various", "mixed", "exotic", "native"]
ACCENTS = ("àáâãäåāăçèéêëēìíîïīñòóôõöøōùúûüūýÿ", "aaaaaaaaceeeeeiiiiinooooooouuuuuyy")
EM_ROUNDS_MOST, EM_SETTLED = 20_000, 1e-9
#: side of a block in reaches: wider blocks hold more pairs, narrower ones more copies of a row
BLOCK_REACHES = 3


def meant_position(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds x_lon, x_lat: the position as meant. Swapped coordinates are turned back, a lost minus sign of the
    latitude is restored; anything else outside the country's box, or at 0/0, is null."""
    lo, la = F.col(lon).cast("double"), F.col(lat).cast("double")
    west, _, south, north = BOX
    good = lambda a, b: usable(a, b) & (a.between(west, 180.0) | a.between(-180.0, -175.0)) & b.between(south, north)
    ways = [(lo, la), (la, lo), (lo, -la), (-la, lo), (la, -lo)]
    at = F.coalesce(*[F.when(good(a, b), F.struct(a.alias("a"), b.alias("b"))) for a, b in ways[:3]], F.when(good(la, -lo), F.struct(la.alias("a"), (-lo).alias("b"))))
    return df.withColumn("x_lon", at["a"]).withColumn("x_lat", at["b"])


def name_parts(c: Column) -> Column:
    """struct(genus, epithet) of a typed scientific name; null parts where the name does not tell them.

    Quoted cultivars, bracketed remarks, hybrid marks and words of doubt are left out, 'epithet, Genus' is turned.
    """
    t = F.translate(F.lower(c), *ACCENTS)
    t = F.regexp_replace(t, r"'[^']*'|\"[^\"]*\"|\([^)]*\)|×", " ")
    t = F.regexp_replace(t, r"^\s*([a-z]{4,})\s*,\s*([a-z]+)\b", "$2 $1")
    t = F.btrim(F.regexp_replace(t, r"[^a-z]+", " "))
    t = F.regexp_replace(t, r"^((prob|poss|cf|aff|nr|probably|possibly|maybe) )+|(?<= )x ", "")
    w = F.split(t, " ")
    # ANSI mode: look up without raising where a word is missing
    g, e = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    tells = (F.length(g) > 0) & ~t.isin(NO_NAME) & ~g.isin([x for x in NO_NAME if " " not in x])
    return F.struct(F.when(tells, g).alias("genus"), F.when(tells & (F.length(e) >= 3) & ~e.isin(NO_EPITHET), e).alias("epithet"))


def _near_word(a: Column, b: Column, more: int = 0) -> Column:
    """Equal but for a few typing errors."""
    n = F.least(F.length(a), F.length(b))
    most = F.when(n >= 12, 3 + more).when(n >= 6, 2 + more).otherwise(1)
    return (a == b) | (F.levenshtein(a, b) <= most)


def copy_classes(df: DataFrame, id_col: str, source_col: str, name_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes, members): records of a source with the same place and name parts form one class.

    classes (cls, n, src, nm, x_lon, x_lat), members (cls, id); cls is a 128-bit hash, so no group is gathered.
    Rows with a null id or source or no usable position are left out; n counts rows, members hold an id once.
    """
    p = meant_position(df).where(F.col("x_lon").isNotNull() & F.col(id_col).isNotNull() & F.col(source_col).isNotNull())
    p = p.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), name_parts(F.col(name_col)).alias("nm"), "x_lon", "x_lat")
    what = ["src", "genus", "epithet", "x_lon", "x_lat"]
    cls = F.struct(F.xxhash64(*what).alias("a"), F.xxhash64(F.lit(1), *what).alias("b")).alias("cls")
    p = p.select("id", "src", "nm.genus", "nm.epithet", "x_lon", "x_lat")
    classes = p.groupBy(*what).agg(F.count("*").alias("n")).select(cls, "n", "src", F.struct("genus", "epithet").alias("nm"), "x_lon", "x_lat")
    return classes, p.select(cls, "id").distinct()


def candidate_pairs(classes: DataFrame, reach_m: float = REACH_M) -> DataFrame:
    """Pairs of classes of different sources in a common block, with distance, names and number of record pairs.

    A class goes to the block of its own cell, and in three further passes to the block to its east, north and
    north-east if that lies within the reach, so two points nearer than the reach always meet. A pair comes out of
    the most north-easterly block that both can reach only, so none is repeated.
    """
    per_deg = math.radians(1) * EARTH_M
    # one scale for the whole box keeps the reach at least as wide as asked; 180 W is laid next to 180 E
    scale = math.cos(math.radians(min(abs(BOX[2]), abs(BOX[3]))))
    wide = reach_m * 1.001 * scale / math.cos(math.radians(max(abs(BOX[2]), abs(BOX[3]))))
    high = reach_m * 1.01

    def place(v: str, side: str = "") -> Column:
        """Position in blocks, of which the reach is 1 / BLOCK_REACHES."""
        if v == "x":
            return F.pmod(F.col(f"{side}x_lon"), F.lit(360.0)) * (per_deg * scale / (BLOCK_REACHES * wide))
        return F.col(f"{side}x_lat") * (per_deg / (BLOCK_REACHES * high))

    x, y = place("x"), place("y")
    cell = lambda v: F.floor(v).cast("int")
    edge = lambda v: F.floor(v + 1 / BLOCK_REACHES).cast("int")
    blocks = F.array_distinct(F.array(*[F.struct(i.alias("cx"), j.alias("cy")) for i in (cell(x), edge(x)) for j in (cell(y), edge(y))]))
    side = classes.select("*", F.explode(blocks).alias("at")).select("*", "at.cx", "at.cy").drop("at")
    a, b = side.alias("a"), side.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("cx", "cy")] + [F.col("a.cls") < F.col("b.cls"), F.col("a.src") != F.col("b.src")]
    own = lambda v: (F.col(f"a.c{v}") == F.least(edge(place(v, "a.")), edge(place(v, "b."))))
    pair = a.join(b, on).where(own("x") & own("y"))
    d = metres(F.col("a.x_lon"), F.col("a.x_lat"), F.col("b.x_lon"), F.col("b.x_lat"))
    return pair.select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"), F.col("a.nm").alias("na"), F.col("b.nm").alias("nb"), (F.col("a.n") * F.col("b.n")).alias("n_pairs"), d.alias("distance_m"))


def agreement(pairs: DataFrame, reach_m: float = REACH_M) -> DataFrame:
    """Adds the levels of distance (0 nearest .. 4 out of reach) and name (0 same species, 1 not told, 2 other)."""
    d = F.col("distance_m")
    dist = F.when(d < reach_m * 0.2, 0).when(d < reach_m * 0.4, 1).when(d < reach_m * 0.7, 2).when(d < reach_m, 3).otherwise(4)
    ga, gb, ea, eb = (F.col(c) for c in ("na.genus", "nb.genus", "na.epithet", "nb.epithet"))
    short = (F.length(ga) == 1) | (F.length(gb) == 1)
    genus = lambda more: F.when(short, F.substring(ga, 1, 1) == F.substring(gb, 1, 1)).otherwise(_near_word(ga, gb, more))
    # where one part is written alike, the other may hold errors of both writers
    same = (_near_word(ea, eb) & genus(0)) | ((ea == eb) & genus(2)) | ((ga == gb) & ~short & _near_word(ea, eb, 2))
    name = F.when(ea.isNull() | eb.isNull(), 1).when(same, 0).otherwise(2)
    return pairs.withColumn("l_dist", dist).withColumn("l_name", name)


def em(counts: np.ndarray, levels: tuple[int, int], rounds_most: int = EM_ROUNDS_MOST) -> tuple[np.ndarray, float]:
    """Posterior of a match per pattern of two levels, and the share of matches. counts: levels[0] x levels[1].

    Two-class mixture with conditional independence; the start favours near positions and like names as matches.
    Runs until no posterior moves by more than EM_SETTLED; after rounds_most it takes what it has and warns.
    """
    m = [np.linspace(2.0, 0.2, n) for n in levels]
    u = [np.linspace(0.5, 2.0, n) for n in levels]
    m, u = [x / x.sum() for x in m], [x / x.sum() for x in u]
    share, total = 0.3, max(1.0, counts.sum())
    post = np.zeros(levels)
    for _ in range(rounds_most):
        pm, pu = share * np.outer(*m), (1 - share) * np.outer(*u)
        last, post = post, pm / np.maximum(pm + pu, 1e-300)
        if np.abs(post - last).max() <= EM_SETTLED:
            return post, share
        wm, wu = post * counts, (1 - post) * counts
        share = min(0.999, max(0.001, wm.sum() / total))
        m = [(wm.sum(axis=1 - i) + 0.5) / (wm.sum() + 0.5 * levels[i]) for i in range(2)]
        u = [(wu.sum(axis=1 - i) + 0.5) / (wu.sum() + 0.5 * levels[i]) for i in range(2)]
    warnings.warn(f"match probabilities still move after {rounds_most} rounds", stacklevel=2)
    return post, share


def link_classes(classes: DataFrame, reach_m: float = REACH_M, least_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(links, patterns). links (cls_a, cls_b, confidence, distance_m, l_dist, l_name) of classes that can be the same
    thing: nearer than reach_m, and told the same species, or, where a name tells none, with a posterior of at least
    least_confidence. patterns (l_dist, l_name, n_pairs, confidence): the record pairs of each of the 15 patterns.

    Every pair of a block takes part in the estimation with its number of record pairs; those that can be no link
    are reduced to counts before anything is written. A name that is null, blank or vague agrees with any.
    """
    pairs = agreement(candidate_pairs(classes, reach_m), reach_m)
    open_ = (F.col("l_dist") < 4) & (F.col("l_name") < 2)
    keep = lambda x: F.when(open_, F.col(x)).alias(x)
    kept = cut(pairs.groupBy(keep("cls_a"), keep("cls_b"), "l_dist", "l_name").agg(F.sum("n_pairs").alias("n_pairs"), F.min("distance_m").alias("distance_m")))
    counts = np.zeros((5, 3))
    for r in kept.groupBy("l_dist", "l_name").agg(F.sum("n_pairs").alias("n")).collect():  # 15 patterns at most
        counts[r["l_dist"], r["l_name"]] = r["n"]
    post, _ = em(counts, (5, 3))
    conf = F.lit(0.0)
    for i in range(5):
        for j in range(3):
            conf = F.when((F.col("l_dist") == i) & (F.col("l_name") == j), F.lit(float(post[i, j]))).otherwise(conf)
    links = kept.where(F.col("cls_a").isNotNull()).withColumn("confidence", conf).where((F.col("l_name") == 0) | (F.col("confidence") >= least_confidence))
    rows = [(i, j, int(counts[i, j]), float(post[i, j])) for i in range(5) for j in range(3)]
    patterns = classes.sparkSession.createDataFrame(rows, "l_dist int, l_name int, n_pairs long, confidence double")
    return links.select("cls_a", "cls_b", "confidence", "distance_m", "l_dist", "l_name"), patterns


def link_points(df: DataFrame, id_col: str = "point_id", source_col: str = "source_slug", name_col: str = "scientific_name", reach_m: float = REACH_M, least_confidence: float = 0.0) -> DataFrame:
    """(point_id_a, point_id_b, confidence, distance_m, l_dist, l_name), the smaller id first, each pair once.

    Copies within a source are compared as one class and only the pairs found are spread over their ids. Rows with
    a null id or source or no usable position take no part; an empty table gives no rows.
    """
    classes, members = copy_classes(df, id_col, source_col, name_col)
    links, _ = link_classes(classes, reach_m, least_confidence)
    a, b = (members.select(F.col("cls").alias(f"cls_{k}"), F.col("id").alias(f"id_{k}")) for k in "ab")
    out = links.join(a, "cls_a").join(b, "cls_b").where("id_a <> id_b")
    return out.select(F.least("id_a", "id_b").alias("point_id_a"), F.greatest("id_a", "id_b").alias("point_id_b"), "confidence", "distance_m", "l_dist", "l_name")


def link_patterns(df: DataFrame, id_col: str = "point_id", source_col: str = "source_slug", name_col: str = "scientific_name", reach_m: float = REACH_M) -> DataFrame:
    """The calibration table: per pattern of levels its record pairs, the posterior, and whether it can be a link."""
    _, patterns = link_classes(copy_classes(df, id_col, source_col, name_col)[0], reach_m)
    return patterns.withColumn("link", (F.col("l_dist") < 4) & (F.col("l_name") < 2))
