"""Edges of tree_crown_merge_pilot and the groups they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.components import grouped_ids
from grovekit.operators.forests import PARTITION_EDGES
from grovekit.session import plain_id, table

#: starts the helper items; no plain id holds this character
HELPER = "\x01"


def merge_edges(rows: DataFrame) -> DataFrame:
    """(a, b): a row links its primary and member; rows of one cluster and run link all their ids.

    A cluster of a run is a helper item linked with every id that its rows name, so no group is ever gathered.
    Rows without cluster or run link only their own two ids.
    """
    r = rows.select(
        plain_id("primary_tree_id").alias("p"),
        plain_id("member_tree_id").alias("m"),
        F.when(
            F.col("cluster_id").isNotNull() & F.col("created_at_utc").isNotNull(),
            F.concat(F.lit(HELPER), F.unix_micros(F.col("created_at_utc").cast("timestamp")).cast("string"), F.lit(HELPER), F.col("cluster_id")),
        ).alias("c"),
    )
    ends = F.when(F.col("c").isNull(), F.array(F.struct(F.col("p").alias("a"), F.col("m").alias("b")))).otherwise(
        F.array(F.struct(F.col("c").alias("a"), F.col("p").alias("b")), F.struct(F.col("c").alias("a"), F.col("m").alias("b")))
    )
    return r.select(F.explode(ends).alias("e")).select("e.a", "e.b")


def merge_groups(spark: SparkSession, d: str, partition_edges: int = PARTITION_EDGES, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """(tree_id, group_tree_id) of every tree id linked to another one."""
    got = grouped_ids(merge_edges(table(spark, d, "tree_crown_merge_pilot")), HELPER, partition_edges, rounds)
    return got.select(F.col("item").alias("tree_id"), F.col("group_id").alias("group_tree_id"))
