"""References to records that do not exist: orphan references per table and period.

References are pre-aggregated per key and period, heavy keys take a broadcast look-up whose size is bounded by
the definition of heavy, the rest a shuffled outer join; the findings of both are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.session import bounded_collect, cut, union_all

HEAVY_KEYS_MOST = 1_000


def pre_aggregate(df: DataFrame, name: str, key: Column, at: Column) -> DataFrame:
    """Per key and month of one referring table: number of rows, first and last instant. Null keys are no reference."""
    rows = df.select(F.lit(name).alias("table_name"), key.alias("key"), at.alias("at")).where(F.col("key").isNotNull())
    rows = rows.withColumn("period", F.date_format("at", "yyyy-MM"))
    return rows.groupBy("table_name", "key", "period").agg(F.count("*").alias("n_rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def orphan_references(children: dict[str, tuple[DataFrame, Column, Column]], parent: DataFrame, parent_key: Column, born: Column, died: Column, heavy_share: float = 1 / HEAVY_KEYS_MOST) -> DataFrame:
    """(table_name, key, period, kind, n_rows): references that are missing, late or deleted.

    children: table name -> (rows, key column, instant column). A parent lives from its earliest `born` to its
    `died` (the earliest, if rows differ). A reference is missing when no parent row has the key, late when an
    instant of the period lies before `born`, deleted when one lies at or after `died`; a key and period can be both.
    References without an instant can only be missing and have a null period. n_rows counts the references of the
    key in the period. Heavy keys, those with more than `heavy_share` of all referring rows (so fewer than
    1/heavy_share of them at any size), are looked up by broadcast; all others by a shuffled join. Empty tables give
    no rows.
    """
    if not 0 < heavy_share <= 1:
        raise ValueError("heavy_share must lie in (0, 1]")
    refs = cut(union_all([pre_aggregate(df, n, k, at) for n, (df, k, at) in children.items()]))
    total = refs.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    heavy = refs.groupBy("key").agg(F.sum("n_rows").alias("n")).where(F.col("n") > F.lit(total * heavy_share)).select("key")
    hot = [r[0] for r in bounded_collect(heavy, int(1 / heavy_share), "heavy keys")]
    rows = parent.select(parent_key.alias("key"), born.alias("born"), died.alias("died")).where(F.col("key").isNotNull())
    span = lambda df: df.groupBy("key").agg(F.min("born").alias("born"), F.min("died").alias("died"), F.lit(1).alias("known"))
    lives, cold, parts = span(rows), refs, []
    if hot:
        names = df_of_keys(refs, hot)
        cold = refs.join(F.broadcast(names), "key", "left_anti")
        some = span(rows.join(F.broadcast(names), "key", "left_semi"))
        parts.append(refs.join(F.broadcast(names), "key", "left_semi").join(F.broadcast(some), "key", "left"))
    parts.append(cold.join(lives, "key", "left"))
    both = union_all(parts)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), F.lit("missing")),
            F.when(F.col("first_at") < F.col("born"), F.lit("late")),
            F.when(F.col("last_at") >= F.col("died"), F.lit("deleted")),
        )
    )
    return both.select("table_name", "key", "period", F.explode(kinds).alias("kind"), "n_rows")


def df_of_keys(like: DataFrame, keys: list) -> DataFrame:
    return like.sparkSession.createDataFrame([(k,) for k in keys], f"key {like.schema['key'].dataType.simpleString()}")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Per table, period and kind: orphan keys and the references that name them."""
    return orphans.groupBy("table_name", "period", "kind").agg(F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_references"))
