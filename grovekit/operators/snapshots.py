"""What changed between full snapshots of a table.

Every key has a persistent ordinal: its slot (a fixed hash) and its rank there by first snapshot and key, so later
snapshots only append. A compressed bitmap per snapshot tells the ordinals present; AND-NOT of consecutive bitmaps
gives removals and additions, AND gives the common ordinals, whose column vectors are compared place by place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions.bitmaps import Bitmap
from grovekit.session import bounded_collect, union_all

#: slots are part of an ordinal: another number gives other ordinals
SLOTS = 4096
GROUP_KEYS = 40_000
SNAPSHOTS_AT_ONCE = 32
TOLERANCE = 1e-6
WHOLE = ("tinyint", "smallint", "int", "bigint")


def slot_of(key_cols: Sequence[str], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key_cols), F.lit(slots)).cast("long")


def ordinal(slot: Column, rank: Column) -> Column:
    """slot in the high, rank in the low 32 bits."""
    return F.shiftleft(slot, 32).bitwiseOR(rank.cast("long"))


def key_ordinals(rows: DataFrame, key_cols: Sequence[str], snapshot_col: str = "snapshot_no", slots: int = SLOTS, known: DataFrame | None = None) -> DataFrame:
    """(*key_cols, ordinal) of each distinct key of the snapshots, the same on every run and whatever the partitioning.

    Ranks in a slot go by first snapshot and key, so a further snapshot leaves all earlier ordinals as they are. With
    `known`, an ordinal table stored before, its keys keep theirs even where their first snapshot is no longer
    delivered, and others follow. A slot may hold 2^32 keys. Rows without a snapshot number are left out; a null in a
    key is a value of its own.
    """
    k = list(key_cols)
    keys = rows.where(F.col(snapshot_col).isNotNull()).groupBy(*k).agg(F.min(snapshot_col).alias("__first")).withColumn("__slot", slot_of(k, slots))
    rank = F.row_number().over(Window.partitionBy("__slot").orderBy("__first", *k)).cast("long") - 1
    if known is None:
        return keys.select(*k, ordinal(F.col("__slot"), rank).alias("ordinal"))
    new = keys.alias("n").join(known.alias("o"), [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in k], "left_anti")
    top = known.groupBy(F.shiftright("ordinal", 32).alias("__slot")).agg((F.max(F.col("ordinal").bitwiseAND(F.lit((1 << 32) - 1))) + 1).alias("__base"))
    new = new.join(top, "__slot", "left").withColumn("ordinal", ordinal(F.col("__slot"), F.coalesce("__base", F.lit(0)) + rank))
    return known.select(*k, "ordinal").unionByName(new.select(*k, "ordinal"))


def _differ(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    na, nb = np.isnan(a), np.isnan(b)
    with np.errstate(invalid="ignore"):
        return np.where(na | nb, na != nb, ~(np.abs(a - b) < tolerance))


def _differ_of_group(shots: list[int], keys: list[str], exact: list[str], numeric: list[str], names: list[str], tolerance: float):
    """The function that finds the changes of one group of keys."""

    def diff(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal", ignore_index=True)
        every = pdf["ordinal"].to_numpy(np.int64)
        maps = [Bitmap.of(every[pdf[f"p{j}"].to_numpy(bool)]) for j in range(len(shots))]
        cols = {v: [pdf[f"{v}_{j}"].to_numpy() for j in range(len(shots))] for v in [*exact, *numeric]}
        parts = []
        for j in range(1, len(shots)):
            old, new = maps[j - 1], maps[j]
            both = np.searchsorted(every, old.and_(new).ordinals())
            changed = np.zeros(both.size, dtype=bool)
            for v in exact:
                changed |= cols[v][j - 1][both] != cols[v][j][both]
            for v in numeric:
                changed |= _differ(cols[v][j - 1][both], cols[v][j][both], tolerance)
            for kind, at in (("added", np.searchsorted(every, new.and_not(old).ordinals())), ("removed", np.searchsorted(every, old.and_not(new).ordinals())), ("changed", both[changed])):
                x = pdf[keys].iloc[at].copy()
                x.insert(0, "snapshot_no", shots[j])
                x["change_kind"] = kind
                parts.append(x)
        return pd.concat(parts, ignore_index=True).set_axis(["snapshot_no", *names, "change_kind"], axis=1)

    return diff


def _halves(c: Column, kind: str) -> tuple[Column, Column]:
    """A value as two whole numbers that are never null: itself and whether it is null, or its 128-bit hash."""
    if kind in WHOLE:
        return F.coalesce(c.cast("long"), F.lit(0)), c.isNull().cast("long")
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def snapshot_changes(
    df: DataFrame,
    key_cols: Sequence[str],
    exact: dict[str, Column] | None = None,
    numeric: Sequence[str] = (),
    snapshot_col: str = "snapshot_no",
    tolerance: float = TOLERANCE,
    group_keys: int = GROUP_KEYS,
    slots: int = SLOTS,
) -> DataFrame:
    """(snapshot_no, *key_cols, change_kind) for each two consecutive snapshots.

    exact: values compared after normalisation (name -> Column), whole numbers as they are, others by a 128-bit hash;
    numeric: values that are equal when less than `tolerance` apart, whole-number columns compared exactly. Two
    nulls are equal. Repeated rows of a key in a snapshot count once (the smallest value or hash per column). Rows
    without a snapshot number are left out; a null in a key is a value of its own. An empty table, or one with a
    single snapshot, gives no rows. NaN counts as null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    same = [(c, df.select(c).schema[0].dataType.simpleString()) for c in (exact or {}).values()] + [(F.col(c), kinds[c]) for c in numeric if kinds[c] in WHOLE]
    near = [c for c in numeric if kinds[c] not in WHOLE]
    k = list(key_cols)
    base = df.where(F.col(snapshot_col).isNotNull()).select(
        F.col(snapshot_col).cast("long").alias("__s"),
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(k)],
        *[h.alias(f"__{half}{i}") for i, (c, kind) in enumerate(same) for half, h in zip("ef", _halves(c, kind))],
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"__n{i}") for i, c in enumerate(near)],
    )
    sizes = {r["__s"]: r["count"] for r in bounded_collect(base.groupBy("__s").count(), 100_000, "snapshots")}
    every = sorted(sizes)
    keys = [f"__k{i}" for i in range(len(k))]
    ints = [f"__{half}{i}" for i in range(len(same)) for half in "ef"]
    reals = [f"__n{i}" for i in range(len(near))]
    schema = ", ".join(["snapshot_no long", *[f"`{c}` {kinds[c]}" for c in k], "change_kind string"])
    out = df.sparkSession.createDataFrame([], schema)
    # blocks of snapshots that overlap in one, so that any number of them can be handled; a key's first snapshot is
    # looked for in all up to the block, which gives it the same ordinal in each
    for lo in range(0, max(len(every) - 1, 0), SNAPSHOTS_AT_ONCE - 1):
        shots = every[lo : lo + SNAPSHOTS_AT_ONCE]
        here = lambda s, v: F.when(F.col("__s") == s, v)
        aggs = [F.min("__s").alias("__first")]
        aggs += [F.coalesce(F.max(here(s, F.lit(True))), F.lit(False)).alias(f"p{j}") for j, s in enumerate(shots)]
        aggs += [F.coalesce(F.min(here(s, F.col(v))), F.lit(0)).alias(f"{v}_{j}") for j, s in enumerate(shots) for v in ints]
        aggs += [F.min(here(s, F.col(v))).alias(f"{v}_{j}") for j, s in enumerate(shots) for v in reals]
        wide = base.where(F.col("__s") <= shots[-1]).groupBy(*keys).agg(*aggs)
        groups = min(slots, max(1, -(-max(sizes[s] for s in shots) // group_keys)))
        wide = wide.withColumn("__slot", slot_of(keys, slots)).withColumn("__g", F.floor(F.col("__slot") * groups / slots))
        # a slot lies in one group, so both the ranks and the groups need this shuffle only
        rank = F.row_number().over(Window.partitionBy("__g", "__slot").orderBy("__first", *keys)) - 1
        wide = wide.repartition("__g").withColumn("__rank", rank).withColumn("__h", F.floor(F.col("__rank") / group_keys))
        wide = wide.where(reduce(Column.__or__, [F.col(f"p{j}") for j in range(len(shots))]))
        wide = wide.select("__g", "__h", ordinal(F.col("__slot"), F.col("__rank")).alias("ordinal"), *keys, *[f"p{j}" for j in range(len(shots))], *[f"{v}_{j}" for v in [*ints, *reals] for j in range(len(shots))])
        out = out.unionByName(wide.groupBy("__g", "__h").applyInPandas(_differ_of_group(shots, keys, ints, reals, k, tolerance), schema))
    return out


def lineage_changes(lineage: DataFrame, summary: DataFrame, plain) -> DataFrame:
    """Changes of both lineage tables with the columns of p2_found."""
    a = snapshot_changes(
        lineage, ["old_seg_key", "new_seg_key"], {"old_tree_id": plain("old_tree_id")}, ["intersection_m2", "old_fraction", "new_fraction"]
    ).withColumn("table_name", F.lit("tree_crown_lineage_v5"))
    b = (
        snapshot_changes(summary, ["new_seg_key"], {}, ["old_overlapping_crowns"])
        .withColumn("table_name", F.lit("v5_lineage_new_summary"))
        .withColumn("old_seg_key", F.lit(""))
    )
    return union_all([a, b]).select("table_name", F.col("snapshot_no").cast("int").alias("snapshot_no"), "old_seg_key", "new_seg_key", "change_kind")
