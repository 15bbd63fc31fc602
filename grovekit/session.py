"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "grovekit", cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir.

    Only where no folder is named and all runs in one process (tests, a laptop) a temporary one is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="grovekit-"))
    return df.checkpoint(eager=True)


def current(df: DataFrame, col: str = "snapshot_no") -> DataFrame:
    """The rows of the last snapshot delivered; an empty table has none."""
    return df.where(F.col(col) == df.agg(F.max(col)).scalar())


def rows_of(df: DataFrame) -> int:
    return df.count()


def plain_id(c: Column | str) -> Column:
    """Plain form of a tree id: spaces and tabs around it removed, lower case, blank as null."""
    return F.nullif(F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t"))), F.lit(""))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def bounded_collect(df: DataFrame, most: int, what: str) -> list:
    """Collects a table whose size must be bounded; raises beyond the bound instead of filling the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows
