"""Reading and writing of the formats that inventories come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovekit.session import bounded_collect, cut

c = F.col


def read_geojson(spark: SparkSession, path: str, properties: T.StructType, geometry: str = "array<double>") -> DataFrame:
    """Features of FeatureCollection files: the properties, geometry_type and coordinates.

    Files are parsed whole, one task each; convert files of many GB to lines with `features_of_text` first.
    """
    place = T.StructType.fromDDL(f"geometry struct<type:string,coordinates:{geometry}>")
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", properties), *place.fields])))])
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", c("f.geometry.type").alias("geometry_type"), c("f.geometry.coordinates").alias("coordinates"))


def split_features(chunks):
    """Objects of the features array of a FeatureCollection read piece by piece, by brace depth outside strings."""
    depth, start, quoted, escaped, text, begun = 0, -1, False, False, "", False
    for chunk in chunks:
        at = len(text)
        text += chunk
        if not begun:
            k = text.find('"features"')
            k = text.find("[", k) if k >= 0 else -1
            if k < 0:
                continue
            text, begun = text[k + 1 :], True
            at = 0
        for i in range(at, len(text)):
            ch = text[i]
            if quoted:
                quoted = escaped or ch != '"'
                escaped = ch == "\\" and not escaped
            elif ch == '"':
                quoted = True
            elif ch == "{":
                if depth == 0:
                    start = i
                depth += 1
            elif ch == "}":
                depth -= 1
                if depth == 0:
                    yield text[start : i + 1]
                    start = -1
        text = text[start:] if start >= 0 else ""
        if start >= 0:
            start = 0


def features_of_text(spark: SparkSession, path: str, size: int = 1 << 20) -> DataFrame:
    """(feature) JSON texts of single-line FeatureCollections of any length, streamed through a bounded buffer."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for p in pdf["path"]:
                with open(p.removeprefix("file:"), encoding="utf-8") as f:
                    out = []
                    for x in split_features(iter(lambda: f.read(size), "")):
                        out.append(x)
                        if len(out) == 1000:
                            yield pd.DataFrame({"feature": out})
                            out = []
                    yield pd.DataFrame({"feature": out})

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, "feature string")


def read_geojson_lines(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    place = T.StructType.fromDDL("geometry struct<type:string,coordinates:array<double>>")
    schema = T.StructType([T.StructField("properties", properties), *place.fields])
    f = spark.read.schema(schema).json(path)
    return f.select("properties.*", c("geometry.coordinates")[0].alias("lon"), c("geometry.coordinates")[1].alias("lat"))


def read_csv_typed(spark: SparkSession, path: str, types: dict[str, str], keep: Column | None = None, sep: str = ",") -> DataFrame:
    """CSV (also gzipped, also tab-separated) with every value cast leniently: what does not fit is null."""
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", False).csv(path)
    got = [(F.btrim(c(f"`{n}`")).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in types.items()]
    out = raw.select(*got)
    return out if keep is None else out.where(keep)


def verify_count(df: DataFrame, expected: int, what: str) -> DataFrame:
    n = df.count()
    if n != expected:
        raise ValueError(f"{what}: {n} rows, {expected} expected")
    return df


def read_tiles(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Parquet tiles as one table, a key kept once (the first in `order`)."""
    d = spark.read.parquet(path)
    k = F.struct(*order, *[x for x in d.columns if x not in order])
    return d.groupBy(*key).agg(F.min(k).alias("m")).select(*[c(f"m.{x}").alias(x) if x not in key else c(x) for x in d.columns])


def write_slices(df: DataFrame, path: str, column: str) -> None:
    """Overwrites only the slices (values of the column) that the data holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_shards(shards: DataFrame, path: str, files: int) -> None:
    """Bodies as text, one row a shard, spread over as many files; the bucket stays beside the body."""
    shards.repartitionByRange(files, "bucket").sortWithinPartitions("bucket").select(F.concat_ws("\t", "path", "body").alias("value")).write.mode("overwrite").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).select(F.split("value", "\t", 2).alias("p"))
    return t.select(c("p")[0].alias("path"), c("p")[1].alias("body"))


def write_features(df: DataFrame, feature: Column, path: str) -> None:
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_export(df: DataFrame, path: str, described: dict[str, str]) -> None:
    """Curated columns as Parquet with their descriptions in the schema, and as gzipped CSV."""
    out = df.select(*[c(k).alias(k, metadata={"comment": v}) for k, v in described.items()])
    out.write.mode("overwrite").parquet(f"{path}/parquet")
    out.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/csv")


def dictionary(df: DataFrame) -> list[tuple[str, str, str]]:
    return [(f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for f in df.schema]


def register(manifest: DataFrame, name: str, release: str, path: str, rows: int) -> DataFrame:
    """Adds a product to a manifest (name, release, path, rows); another release of the name is an error."""
    other = manifest.where((c("name") == name) & (c("release") != release)).limit(1).collect()
    if other:
        raise ValueError(f"{name} is registered for release {other[0]['release']}")
    new = manifest.sparkSession.createDataFrame([(name, release, path, rows)], "name string, release string, path string, rows long")
    return cut(manifest.where(c("name") != name).select("name", "release", "path", "rows").unionByName(new))


def count_report(df: DataFrame, column: str, n: int = 10) -> str:
    """Markdown table of the n commonest values."""
    g = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(c("n").desc(), column).limit(n)
    return "\n".join([f"| {column} | n |", "|-|-|", *[f"| {r[0]} | {r['n']} |" for r in bounded_collect(g, n, "report")]])
