"""Consolidating pairwise matches into groups.

The links go through union-find in bounded edge partitions, only the spanning forests are kept, and forests are
merged in rounds through bounded partitions until the global components remain (grovekit.operators.forests); a
group is then named by its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.operators.forests import PARTITION_EDGES, connected_components


def grouped_ids(edges: DataFrame, hidden: str | None = None, partition_edges: int = PARTITION_EDGES, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """(item, group_id): the group's id is its smallest item in string order.

    Items that start with `hidden` are helpers (one per cluster, say): they link but do not come out, and a group
    with a single other item is left out. `rounds`, if given, receives the edges and partitions of each round.
    """
    label = connected_components(edges, partition_edges, rounds=rounds)
    if hidden:
        label = label.withColumn("__shown", ~F.col("item").startswith(hidden))
    else:
        label = label.withColumn("__shown", F.lit(True))
    shown = label.where("__shown")
    head = shown.groupBy("root").agg(F.min("item").alias("group_id"), F.count("*").alias("__n")).where("__n > 1").select("root", "group_id")
    return shown.join(head, "root").select("item", "group_id")
