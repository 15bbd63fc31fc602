"""Mixing sources to target weights.

Each document gets a hash-random key; the documents are range-sorted by source and key, the sums of the range
partitions give every partition its offset, and a source is cut where its prefix sum reaches the budget. Small
sources are repeated in whole epochs before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.llm.tokens import FOLDER, encoder
from grovekit.session import bounded_collect, cut

SOURCES_MOST = 10_000
#: the mix's size as a share of the tokens of all target sources
FRACTION = 0.1


def token_counter(folder: str = FOLDER):
    """pandas UDF: number of tokens of a text; null counts 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc, _ = encoder(folder)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return count


def plain_source(c: Column) -> Column:
    """Source names compare without case, outer space, and with - and blanks as _."""
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t"))), r"[\s\-]+", "_")


def _aims(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Target share and most repeats of each source; nulls count 0, of repeated rows the largest values hold."""
    t = targets.select(plain_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("long").alias("m"))
    t = t.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.nanvl("w", F.lit(0.0))).alias("w"), F.max("m").alias("m"))
    return {r["source"]: (max(0.0, r["w"] or 0.0), max(0, r["m"] or 0)) for r in bounded_collect(t, SOURCES_MOST, "targets")}


def mix(documents: DataFrame, targets: DataFrame, fraction: float = FRACTION, seed: int = 17, total_tokens: int | None = None, folder: str = FOLDER) -> tuple[DataFrame, DataFrame]:
    """(chosen, report). chosen: (doc_id, source, n_tokens, copies) of the documents used, copies the times of use.
    report: per target source its share and tokens, aimed at and reached, and the tokens it falls short.

    The total is `fraction` of the tokens of all target sources, or total_tokens where given; each source's budget
    is its share of it. A source that cannot fill its budget within max_repeats gives all that it may and the rest
    is reported as short_tokens, so a scarce source never holds back the others; largest_exact_total tells the
    largest total at which none falls short. A source without documents is reported with 0.
    Documents of other sources, without source or without tokens are not used; a document in two rows counts as
    two. Of each source whole epochs are taken while the budget holds, then the documents in random order up to
    the budget, which is missed by at most half of one document's tokens. Ties of the random key go by doc_id.
    """
    aim = _aims(targets)
    d = documents.select("doc_id", plain_source(F.col("source")).alias("source"), "text").where(F.col("source").isin(list(aim)))
    d = d.select("doc_id", "source", token_counter(folder)("text").alias("n_tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("key")).where("n_tokens > 0")
    # counted once, sorted once: the ranges are the partitions of the checkpoint
    counted = cut(d)
    ranged = cut(counted.repartitionByRange(*_ranges(counted), "source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id"))
    ranged = ranged.withColumn("part", F.spark_partition_id())
    # one row per range and source
    sums = ranged.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).collect()
    have: dict[str, int] = {s: 0 for s in aim}
    offset: dict[tuple[str, int], int] = {}
    for r in sorted(sums, key=lambda r: (r["source"], r["part"])):
        offset[(r["source"], r["part"])] = have[r["source"]]
        have[r["source"]] += r["n"]
    able = [have[s] * m / w for s, (w, m) in aim.items() if have[s] and w > 0 and m]
    total = float(total_tokens) if total_tokens is not None else fraction * sum(have.values())
    plan = {}
    for s, (w, m) in aim.items():
        budget = min(w * total, have[s] * m)
        epochs = int(budget // have[s]) if have[s] else 0
        plan[s] = (epochs, budget - epochs * have[s])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: dict[str, int] = {}
        for pdf in batches:
            for s, g in pdf.groupby("source", sort=False):
                start = run.get(s, offset[(s, int(g["part"].iloc[0]))])
                end = start + g["n_tokens"].to_numpy().cumsum()
                run[s] = int(end[-1])
                epochs, rest = plan[s]
                # the document across the budget is taken if that comes nearer to it
                copies = epochs + (2 * end - g["n_tokens"].to_numpy() <= 2 * rest + 1e-6).astype(np.int64)
                g = g.assign(copies=copies)[copies > 0]
                if len(g):
                    yield g[["doc_id", "source", "n_tokens", "copies"]]

    chosen = ranged.mapInPandas(choose, "doc_id long, source string, n_tokens long, copies long")
    used = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    rows = [(s, w, m, have[s], w * total, max(0.0, w * total - have[s] * m), min(able, default=0.0)) for s, (w, m) in sorted(aim.items())]
    base = documents.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats long, tokens_there long, tokens_aimed double, short_tokens double, largest_exact_total double")
    report = base.join(used, "source", "left").fillna(0, ["n_documents", "tokens_used", "most_copies"])
    report = report.withColumn("t", used.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("t")).scalar())
    share = F.when(F.col("t") > 0, F.col("tokens_used") / F.col("t")).otherwise(0.0)
    return chosen, report.select(*base.columns, "n_documents", "tokens_used", "most_copies", share.alias("share_reached"))


def _ranges(df: DataFrame) -> list[int]:
    return [max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))]
