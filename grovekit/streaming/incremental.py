"""Append-only ledgers and idempotent incremental features with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines as a stream; malformed lines give null columns."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest(ledger: DataFrame, key: str, order: str, state: str, removed: str = "removed") -> DataFrame:
    """State of each key after all its entries; a last entry `removed` takes the key out."""
    g = ledger.groupBy(key).agg(F.max(F.struct(order, state)).alias("m"))
    return g.select(key, c(f"m.{state}").alias(state), c(f"m.{order}").alias(order)).where(c(state) != removed)


def upsert_batches(stream: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], target: str, checkpoint: str):
    """Starts a query that writes each micro-batch's partial aggregates under its number.

    aggregates: name -> (column, sum | min | max | count). A batch that is tried again replaces its own folder, so
    totals are exact after a failure; `read_totals` merges the partials.
    """

    def sink(batch: DataFrame, number: int) -> None:
        fs = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
        part = batch.groupBy(*keys).agg(*[fs[f](x).alias(n) for n, (x, f) in aggregates.items()])
        part.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_totals(spark: SparkSession, target: str, keys: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    fs = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    return spark.read.parquet(target).groupBy(*keys).agg(*[fs[f](n).alias(n) for n, (_, f) in aggregates.items()])


def completed(done: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """Tiles that are still to be worked on."""
    return tiles.join(done.select(key).distinct(), key, "left_anti")
