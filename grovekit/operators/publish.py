"""Shards, search, address look-up, key resolution, release checks and record pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions import text
from grovekit.functions.ids import fnv1a
from grovekit.session import union_all

c = F.col


def key_shards(df: DataFrame, key: str, fields: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, path, n, body): JSON object key -> values per hash bucket, keys in order; a bucket is a bounded file."""
    h = fnv1a(c(key)) % buckets
    d = df.where(c(key).isNotNull()).select(h.alias("bucket"), c(key).alias("__k"), F.struct(*fields).alias("__v"))
    g = d.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("__k", "__v"))).alias("e"), F.count("*").alias("n"))
    body = F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["__k"].alias("key"), x["__v"].alias("value")))))
    hexa = F.lpad(F.lower(F.hex(F.floor(c("bucket") / 256))), 2, "0")
    low = F.lpad(F.lower(F.hex(c("bucket") % 256)), 2, "0")
    return g.select("bucket", F.concat(hexa, F.lit("/"), low, F.lit(".json")).alias("path"), "n", body.alias("body"))


def reshard(bucket: Column, old: int, new: int, key: Column) -> Column:
    """Bucket of a finer split: bucket modulo the old number stays, so each old file splits on its own."""
    return F.when(fnv1a(key) % old == bucket, fnv1a(key) % new)


def shard_check(shards: DataFrame, total: Column) -> DataFrame:
    """Rows over all shards and the sum that they hold."""
    return shards.agg(F.sum("n").alias("n"), F.count("*").alias("n_shards"), total.alias("total"))


def cell_index(df: DataFrame, lon: str, lat: str, fields: Sequence[str], per_degree: int = 100) -> DataFrame:
    """(cell, n, members): members of each cell of 1/per_degree degrees in a fixed order."""
    d = df.where(c(lon).isNotNull() & c(lat).isNotNull())
    cell = F.concat_ws("_", F.floor(c(lon) * per_degree).cast("string"), F.floor(c(lat) * per_degree).cast("string"))
    return d.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*fields))).alias("members"))


def address_index(df: DataFrame, street: str, suburb: str, number: str, unit: str) -> DataFrame:
    n = text.split_number(c(number), c(unit))
    out = df.withColumn("street_norm", text.norm_street(c(street))).withColumn("suburb_norm", text.norm_text(c(suburb)))
    return out.withColumn("number_norm", n["number"]).withColumn("unit_norm", n["unit"]).withColumn("shard", text.prefix_key(c("street_norm")))


def address_search(queries: DataFrame, query: str, index: DataFrame, id_col: str, limit: int = 8) -> DataFrame:
    """(query, rank, id, score, suburb_mismatch): addresses whose street begins with the typed one.

    Rank: exact street first, then a longer number, then another unit. Without a hit in the typed suburb the street
    counts wherever it is. Joins on the prefix shard.
    """
    q = text.address_query(c(query))
    t = queries.select(c(query).alias("query"), q["unit"].alias("qu"), q["number"].alias("qn"), text.norm_street(q["street"]).alias("qs"), text.norm_text(q["suburb"]).alias("qb")).distinct()
    t = t.where(F.length("qs") >= 2).withColumn("shard", text.prefix_key(c("qs")))
    j = t.join(index, "shard").where(c("street_norm").startswith(c("qs")))
    j = j.where(c("qn").isNull() | c("number_norm").startswith(c("qn")))
    score = F.when(c("street_norm") == c("qs"), 0).otherwise(1) + F.when(c("qn").isNull() | (c("number_norm") == c("qn")), 0).otherwise(4) + F.when(c("qu").isNull() | c("unit_norm").eqNullSafe(c("qu")), 0).otherwise(2)
    j = j.withColumn("score", score).withColumn("in_suburb", (F.coalesce("qb", F.lit("")) == "") | c("suburb_norm").startswith(c("qb")))
    any_in = j.groupBy("query").agg(F.max("in_suburb").alias("any_in"))
    j = j.join(any_in, "query").where(c("in_suburb") | ~c("any_in"))
    w = Window.partitionBy("query").orderBy("score", "street_norm", "suburb_norm", F.length("number_norm"), "number_norm", id_col)
    return j.withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit).select("query", "rank", c(id_col).alias("id"), "score", (~c("in_suburb")).alias("suburb_mismatch"))


def _grams(w: Column, n: int) -> Column:
    """All runs of n letters of a word; none where it is shorter."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.length(w)), lambda i: F.concat(F.lit(f"{n}"), F.substr(w, i, F.lit(n))))


def search_pairs(queries: DataFrame, query: str, tokens: str, items: DataFrame, item_id: str, label: str) -> DataFrame:
    """(query, tokens, item_id, label): every pair that phrase_score can rate above 0, and some that it cannot.

    A rated item holds each token inside a word, or within one edit of a word or of its beginning (five letters and
    more). So the longest token's first three letters, or for an edit its first or its last two (three from seven
    letters on), occur in some word of the item; queries and items meet in these runs of letters. Exact copies of an
    item count once, tokens null or empty pair with nothing.
    """
    longest = F.array_max(F.transform(c(tokens), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    t = queries.select(c(query).alias("query"), c(tokens).alias("tokens"), longest.alias("t")).where("t <> ''").distinct()
    n = F.length("t")
    run = lambda k, a: F.concat(F.lit(f"{k}"), F.substr(c("t"), a, F.lit(k)))
    edge = lambda k: F.array(run(k, F.lit(1)), run(k, n - k + 1))
    inside = F.when(n >= 3, run(3, F.lit(1))).when(n == 2, run(2, F.lit(1))).otherwise(run(1, F.lit(1)))
    keys = F.array_union(F.array(inside), F.when(n >= 7, edge(3)).when(n >= 5, edge(2)).otherwise(F.array(inside)))
    a = t.select("query", "tokens", F.explode(F.array_distinct(keys)).alias("h"))
    every = F.array_distinct(F.flatten(F.transform(text.words(text.search_text(c("label"))), lambda w: F.concat(*[_grams(w, k) for k in (1, 2, 3)]))))
    b = items.select(c(item_id).alias("item_id"), c(label).alias("label")).distinct().select("item_id", "label", F.explode(every).alias("h"))
    return a.join(b, "h").drop("h").distinct()


def ranked_search(queries: DataFrame, query: str, items: DataFrame, label: str, group: str, item_id: str, per_group: int = 3, limit: int = 10, least: float = 45.0) -> DataFrame:
    """(query, rank, item_id, group, score): the best items of at least `least` above 0, a few of each group.

    Of an item's labels in a group the best counts. Candidates are all that can score at all (search_pairs).
    """
    q = queries.select(c(query).alias("query"), text.search_query(c(query))["tokens"].alias("tokens")).distinct()
    b = items.select(F.struct(c(item_id).alias("i"), c(group).alias("g")).alias("ref"), c(label).alias("label"))
    j = search_pairs(q, "query", "tokens", b, "ref", "label").withColumn("score", text.phrase_score(c("tokens"), c("label"))).where(c("score") >= least)
    j = j.groupBy("query", c("item_id.i").alias("item_id"), c("item_id.g").alias("group")).agg(F.min(F.struct((-c("score")).alias("s"), "label")).alias("m"))
    j = j.select("query", "item_id", "group", (-c("m.s")).alias("score"), c("m.label").alias("label"))
    o = [c("score").desc(), c("label"), c("item_id")]
    j = j.withColumn("g", F.row_number().over(Window.partitionBy("query", "group").orderBy(*o))).where(c("g") <= per_group)
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*o))).where(c("rank") <= limit).select("query", "rank", "item_id", "group", "score")


def alias_table(old_new: DataFrame, old: str, new: str, alive: DataFrame, key: str) -> DataFrame:
    """(key, status, successors): what became of each key: current, merged, split, retired."""
    l = old_new.where(c(old).isNotNull() & c(new).isNotNull()).select(c(old).alias("o"), c(new).alias("n")).distinct()
    into = l.groupBy("n").agg(F.count("*").alias("parents"))
    s = l.join(into, "n").groupBy("o").agg(F.sort_array(F.collect_list("n")).alias("successors"), F.max("parents").alias("parents"))
    a = alive.select(c(key).alias("key")).distinct().withColumn("is_alive", F.lit(True))
    j = a.join(s.withColumnRenamed("o", "key"), "key", "full")
    n = F.size(F.coalesce("successors", F.array().cast("array<string>")))
    status = F.when(n > 1, "split").when((n == 1) & (c("parents") > 1), "merged").when(n == 1, "current").when(c("is_alive"), "current").otherwise("retired")
    return j.select("key", status.alias("status"), F.coalesce("successors", F.array().cast("array<string>")).alias("successors"))


def resolve(asked: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Asked keys with their status; unknown where the table has none."""
    j = asked.select(c(key).alias("key")).join(table, "key", "left")
    return j.select("key", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("successors", F.array().cast("array<string>")).alias("successors"))


def gates(checks: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """(gate, severity, n_bad, result) from (name, severity, DataFrame of offending rows)."""
    rows = [bad.agg(F.lit(n).alias("gate"), F.lit(s).alias("severity"), F.count("*").alias("n_bad")) for n, s, bad in checks]
    return union_all(rows).withColumn("result", F.when(c("n_bad") == 0, "PASS").otherwise("FAIL"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, checksum): order-free fingerprint of a table; -0.0 counts as 0.0."""
    cols = [F.when(c(f"`{f.name}`") == 0, F.lit(0).cast(f.dataType)).otherwise(c(f"`{f.name}`")) if f.dataType.typeName() in ("double", "float") else c(f"`{f.name}`") for f in df.schema]
    h = F.xxhash64(*cols)
    return df.agg(F.count("*").alias("n"), F.concat(F.hex(F.bit_xor(h)), F.lit("-"), F.sum(F.pmod(h, F.lit(1 << 31))).cast("string")).alias("checksum"))


def incremental(old_result: DataFrame, keys_changed: DataFrame, key: str, rebuilt: DataFrame) -> DataFrame:
    """The old result without the changed keys and their rebuilt rows."""
    return old_result.join(keys_changed.select(key).distinct(), key, "left_anti").unionByName(rebuilt.join(keys_changed.select(key).distinct(), key, "left_semi"))


def view_url(params: Sequence[tuple[str, Column]]) -> Column:
    """Query string of the parameters that are set."""
    return F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(k + "="), F.url_encode(v))) for k, v in params])), "&")


def view_state(url: Column, names: Sequence[str]) -> Column:
    """struct of the named parameters of a query string."""
    m = F.str_to_map(url, F.lit("&"), F.lit("="))
    return F.struct(*[F.url_decode(F.try_element_at(m, F.lit(n))).alias(n) for n in names])


def feature_json(props: Sequence[str], lon: str, lat: str, digits: int = 3, numeric: Sequence[str] = ()) -> Column:
    """GeoJSON feature of a row; null properties are left out, the numeric ones rounded."""
    p = F.struct(*[(F.round(F.nanvl(c(x), F.lit(None).cast("double")), digits) if x in numeric else c(x)).alias(x) for x in props])
    point = F.struct(F.lit("Point").alias("type"), F.array(c(lon), c(lat)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), p.alias("properties"), point.alias("geometry")))
