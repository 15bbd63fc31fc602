"""Identifiers, hashes, folds and tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: base-32 digits of tree numbers, FNV-1a constants
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
FNV_START, FNV_PRIME = 2166136261, 16777619


def fnv1a(c: Column) -> Column:
    """FNV-1a hash (32 bits, as BIGINT) of the UTF-8 bytes."""
    h = F.hex(c.cast("binary"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    hashed = F.aggregate(steps, F.lit(FNV_START).cast("bigint"), lambda a, b: (a.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    return F.when(F.length(h) == 0, F.lit(FNV_START).cast("bigint")).otherwise(hashed)


def sha_id(prefix: str, token: Column, digits: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(token, 256), 1, digits))


def observation_token(years: list[int], x: dict[int, Column], y: dict[int, Column]) -> Column:
    """year:x:y of the epochs observed, two decimals, joined by a pipe in year order."""
    return F.concat_ws("|", *[F.when(x[k].isNotNull(), F.format_string(f"{k}:%.2f:%.2f", x[k], y[k])) for k in sorted(years)])


def block_fold(x: Column, y: Column, size: float, cuts: tuple[int, int] = (6, 8)) -> Column:
    """train, validation or test of a square block, from the first 8 hex digits of its hash modulo 10."""
    token = F.concat_ws(":", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))
    v = F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(v < cuts[0], "train").when(v < cuts[1], "validation").otherwise("test")


def near_block_edge(x: Column, y: Column, size: float, buffer: float) -> Column:
    a, b = F.pmod(x, F.lit(size)), F.pmod(y, F.lit(size))
    return (a < buffer) | (a > size - buffer) | (b < buffer) | (b > size - buffer)


def _digits(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)


def _luhn(s: Column, first: int) -> Column:
    """Luhn sum modulo 32 from the right, factors alternating from `first`."""
    d = F.reverse(_digits(s))
    weighted = F.transform(d, lambda v, i: v * F.when(i % 2 == 0, first).otherwise(3 - first))
    return F.aggregate(weighted, F.lit(0), lambda a, b: a + F.floor(b / 32).cast("int") + b % 32) % 32


def check_char(payload: Column) -> Column:
    """Check character of a payload in base 32."""
    return F.substr(F.lit(ALPHABET), ((F.lit(32) - _luhn(payload, 2)) % 32 + 1).cast("int"), F.lit(1))


def number_text(c: Column) -> Column:
    """Upper case, separators dropped, I and L read as 1, O as 0 after the leading letter."""
    t = F.upper(F.regexp_replace(c, r"[\s\-._]", ""))
    return F.concat(F.substring(t, 1, 1), F.translate(F.substring(t, 2, 100), "ILO", "110"))


def valid_number(n: Column) -> Column:
    """A number of T and seven base-32 digits whose check character fits."""
    return F.coalesce(n.rlike("^T[0-9A-HJKMNP-TV-Z]{7}$") & (_luhn(F.substring(n, 2, 7), 1) == 0), F.lit(False))


def near_numbers(n: Column) -> Column:
    """Sorted valid numbers one changed digit or one swap of neighbours away; empty for a valid number."""
    subs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(8)), lambda i: F.transform(F.split(F.lit(",".join(ALPHABET)), ","), lambda ch: F.concat(F.substr(n, F.lit(1), i - 1), ch, F.substr(n, i + 1)))))
    swaps = F.transform(F.sequence(F.lit(2), F.lit(7)), lambda i: F.concat(F.substr(n, F.lit(1), i - 1), F.substr(n, i + 1, F.lit(1)), F.substr(n, i, F.lit(1)), F.substr(n, i + 2)))
    found = F.array_sort(F.array_distinct(F.filter(F.concat(subs, swaps), lambda s: (s != n) & valid_number(s))))
    shaped = n.rlike("^T[0-9A-HJKMNP-TV-Z]{7}$") & ~valid_number(n)
    return F.when(F.coalesce(shaped, F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def key_kind(c: Column, record_prefix: str) -> Column:
    """Kind of a key: number, crown keys of two forms, record, other."""
    return (
        F.when(c.isNull() | (c == ""), None)
        .when(valid_number(c), "number")
        .when(c.rlike(r"^[A-Za-z0-9_]+:-?\d+(\.\d+)?:-?\d+(\.\d+)?$"), "crown_key")
        .when(c.rlike(r"^\d+_\d+$"), "crown_key_v4")
        .when(c.startswith(record_prefix), "record")
        .otherwise("other")
    )


def tile_xy(lon: Column, lat: Column, zoom: int) -> Column:
    """struct(x, y) of the slippy map tile."""
    n = 2**zoom
    r = F.radians(lat)
    x = F.floor((lon + 180) / 360 * n).cast("long")
    y = F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n).cast("long")
    return F.struct(x.alias("x"), y.alias("y"))


def tile_corner(x: Column, y: Column, zoom: int) -> Column:
    """struct(lon, lat) of a tile's north-west corner."""
    n = 2**zoom
    return F.struct((x / n * 360 - 180).alias("lon"), F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n)))).alias("lat"))


def epoch_ms_year(c: Column) -> Column:
    return F.year(F.timestamp_millis(c.cast("long")))
