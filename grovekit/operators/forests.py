"""Connected components by union-find in edge partitions whose spanning forests are merged in rounds.

Every round runs union-find inside bounded partitions of the edges, keeps only the stars (spanning forests) that
come out, and merges them: an id that is nowhere a root is hung under one of its roots and its other roots are
linked with that one, so the next round holds roots only. When the remaining forest fits one bounded partition it
is finished there. Roots are chosen by a hash of the id, so long chains shrink by a constant share each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.session import cut

#: edges that one task takes at most, and edges that are worth a task of their own while cores are free
PARTITION_EDGES = 150_000
TASK_EDGES = 25_000
ROUNDS_MOST = 60


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root (smallest number) of each of n items under the links a-b."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # path halving for all at once
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars (item, root) of one partition of edges (a, b, ha, hb)."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    e = pd.concat(parts, ignore_index=True)
    ids = pd.concat([e["a"], e["b"]], ignore_index=True)
    rank = pd.concat([e["ha"], e["hb"]], ignore_index=True).to_numpy()
    code, names = pd.factorize(ids)
    first = np.zeros(len(names), dtype=np.int64)
    first[code] = rank
    names = np.asarray(names)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    n = len(e)
    r = roots(place[code[:n]], place[code[n:]], len(names))
    item = np.flatnonzero(r != np.arange(len(r)))
    yield pd.DataFrame({"item": names[order[item]], "root": names[order[r[item]]]})


def _stars(edges: DataFrame, partitions: int) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()
    e = edges.select("a", "b", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"))
    e = e.coalesce(1) if partitions == 1 else e.repartition(partitions, F.xxhash64("a", "b"))
    return e.mapInPandas(_forest, f"item {kind}, root {kind}")


def connected_components(edges: DataFrame, partition_edges: int = PARTITION_EDGES, task_edges: int = TASK_EDGES, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """(item, root) of every item of the edges (a, b), root being the same for all items linked, directly or not.

    Ids are strings or whole numbers. Edges with a null end and loops of one item are no links; an item that has
    only such edges does not come out. Repeated edges count once. An empty table gives no rows. A partition takes
    at most about partition_edges; fewer where cores are free, down to task_edges. `rounds`, if given, receives the
    edges and partitions of each round.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    left = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hung: list[DataFrame] = []
    for _ in range(ROUNDS_MOST):
        n = left.count()
        partitions = max(1, -(-n // partition_edges), min(cores, n // task_edges))
        if rounds is not None:
            rounds.append((n, partitions))
        stars = cut(_stars(left, partitions))
        if partitions == 1:
            label = stars.unionByName(stars.select(F.col("root").alias("item"), "root").distinct())
            break
        # the root with the lowest hash is the one that an item is hung under, as inside the partitions; an item has
        # at most one root a partition
        top = stars.select(F.col("root").alias("item")).distinct().withColumn("is_root", F.lit(1))
        low = stars.groupBy("item").agg(F.min(F.struct(F.xxhash64("root").alias("h"), "root"))["root"].alias("to"), F.collect_set("root").alias("roots"))
        low = cut(low.join(top, "item", "left").withColumn("stays", F.col("is_root").isNotNull()).drop("is_root"))
        hung.append(low.where(~F.col("stays")).select("item", "to"))
        linked = low.select(F.when(F.col("stays"), F.col("item")).otherwise(F.col("to")).alias("x"), F.explode("roots").alias("y"))
        left = cut(linked.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError("the components did not settle")
    # an item whose whole component was hung in one round has its root only there
    for low in reversed(hung):
        named = low.join(label.select(F.col("item").alias("to"), F.col("root").alias("__r")), "to", "left")
        mine = named.select("item", F.coalesce("__r", "to").alias("root"))
        alone = named.where(F.col("__r").isNull()).select(F.col("to").alias("item"), F.col("to").alias("root")).distinct()
        label = cut(label.unionByName(mine).unionByName(alone))
    return label
