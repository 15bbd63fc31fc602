"""Mapping freely typed values to the entries of a reference list.

The reference names and their alias paths form a trie that is searched with a Levenshtein automaton (its states
simulated bit-parallel); all entries within a distance that depends on the length come back, best first.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.session import bounded_collect, plain_id

REFERENCE_MOST = 100_000
#: longer texts are looked up anew each time
KEPT_LENGTH = 1_000
#: fixed values: words before a name, words that name a genus only, remark words after a common name
LEADING = {"prob", "probably", "poss", "possibly", "cf", "aff", "nr", "near", "maybe", "perhaps", "likely"}
GENUS_ONLY = {"sp", "spp", "species", "indet", "unclear", "unknown", "genus"}
HYBRID = {"x"}
SPLIT = re.compile(r"\s*(?:/|;|\||\bor\b|=)\s*")
WORD = re.compile(r"[a-z0-9]+")


def fold(text: str) -> str:
    """Lower case without accents; the multiplication sign becomes x."""
    t = unicodedata.normalize("NFKD", text.replace("×", " x ")).casefold()
    return "".join(ch for ch in t if not unicodedata.combining(ch))


def words(text: str) -> list[str]:
    return WORD.findall(fold(text))


def distance_for(n: int) -> int:
    """Edits allowed for a name of n characters."""
    return 0 if n < 5 else 1 if n < 8 else 2 if n < 16 else 3


class Trie:
    """Names with their entries and kinds as a trie in flat arrays, built in one pass over the sorted names.

    A node holds its letter, first child, next sibling, the name that ends there, and the lengths of all names below
    as bits (63 standing for all longer), so that a search leaves branches without a name of fitting length at once.
    A hundred thousand entries with their alias paths take some hundred megabytes.
    """

    def __init__(self):
        self.exact: dict[str, tuple] = {}
        self.longest = 0
        self._built = False

    def add(self, name: str, entry, kind: str = "") -> None:
        have = self.exact.get(name, ())
        if name and (entry, kind) not in have:
            self.exact[name] = (*have, (entry, kind))
            self.longest = max(self.longest, name.count(" ") + 1)
            self._built = False

    def _build(self) -> None:
        self.names = sorted(self.exact)
        self.letter, self.child, self.beside, self.end, self.lengths = array("I", [0]), array("I", [0]), array("I", [0]), array("i", [-1]), array("Q", [0])
        path, last, before = [0], [0], ""
        for k, name in enumerate(self.names):
            same = 0
            while same < len(before) and same < len(name) and before[same] == name[same]:
                same += 1
            del path[same + 1 :], last[same + 1 :]
            for ch in name[same:]:
                new = len(self.letter)
                for column, value in ((self.letter, ord(ch)), (self.child, 0), (self.beside, 0), (self.end, -1), (self.lengths, 0)):
                    column.append(value)
                if last[-1]:
                    self.beside[last[-1]] = new
                else:
                    self.child[path[-1]] = new
                last[-1] = new
                path.append(new), last.append(0)
            bit = 1 << min(len(name), 63)
            for node in path:
                self.lengths[node] |= bit
            self.end[path[-1]] = k
            before = name
        self._built = True

    def search(self, text: str, most: int) -> list[tuple[int, object, str, str]]:
        """(distance, entry, kind, name) of all names within `most` edits, nearest first."""
        if not self._built:
            self._build()
        n, found = len(text), []
        full, goal = (1 << (n + 1)) - 1, 1 << n
        fits = 0
        for k in range(max(0, n - most), n + most + 1):
            fits |= 1 << min(k, 63)
        letter, child, beside, end, lengths = self.letter, self.child, self.beside, self.end, self.lengths
        if not lengths[0] & fits:
            return found
        mask: dict[int, int] = {}
        for i, ch in enumerate(text):
            mask[ord(ch)] = mask.get(ord(ch), 0) | (1 << i)
        todo = [(child[0], [(1 << (d + 1)) - 1 for d in range(most + 1)])]
        levels = range(1, most + 1)
        while todo:
            node, state = todo.pop()
            while node:
                if lengths[node] & fits:
                    m = mask.get(letter[node], 0)
                    bits = (state[0] & m) << 1
                    new = [bits]
                    for d in levels:
                        below = state[d - 1]
                        bits = ((((state[d] & m) | below | bits) << 1) | below) & full
                        new.append(bits)
                    if bits:
                        if end[node] >= 0 and bits & goal:
                            d = next(d for d, x in enumerate(new) if x & goal)
                            name = self.names[end[node]]
                            found += [(d, e, k, name) for e, k in self.exact[name]]
                        if child[node]:
                            todo.append((child[node], new))
                node = beside[node]
        return sorted(found, key=lambda f: (f[0], str(f[1]), f[2], f[3]))


def _spellings(name: str) -> set[str]:
    """A name in words, and with each long vowel written double."""
    double = re.sub("[āēīōūĀĒĪŌŪ]", lambda m: fold(m[0]) * 2, name)
    return {" ".join(words(name)), " ".join(words(double))}


def reference_trie(rows: list[tuple]) -> Trie:
    """Trie of (taxon_id, scientific_name, genus, common_name, other_names, taxon_rank) with alias paths: turned
    word order, the genus cut to its first letter, double vowels, the genus alone for an entry of that rank."""
    trie = Trie()
    for taxon, scientific, genus, common, others, rank in rows:
        if rank == "genus":
            trie.add((words(genus or scientific or "") or [""])[0], taxon, "genus")
            continue
        latin = [(scientific, "name")] + [(x, "name") for x in (others or "").split(";")]
        for name, kind in [*latin, (common, "common")]:
            for s in _spellings(name or ""):
                w = s.split()
                trie.add(s, taxon, kind)
                if len(w) >= 2:
                    trie.add(" ".join([w[-1], *w[:-1]]), taxon, kind)
                    if name == scientific or (kind == "name" and len(w) == 2):
                        trie.add(" ".join([w[0][0], *w[1:]]), taxon, "short")
    return trie


def _best(found: list, text: str) -> tuple[int, object] | None:
    """The nearest entry, if only one is as near; a genus cut to a letter must keep that letter."""
    ok = [f for f in found if f[2] != "genus" and (f[2] != "short" or f[3].split()[0] == text.split()[0])]
    if not ok:
        return None
    near = {f[1] for f in ok if f[0] == ok[0][0]}
    return (ok[0][0], ok[0][1]) if len(near) == 1 else None


def match_text(trie: Trie, text: str) -> tuple[object, int] | None:
    """(entry, distance) meant by a typed text, or None. Parts divided by a slash are tried in turn."""
    for part in SPLIT.split(text.strip()):
        w = words(part)
        while w and (w[0] in LEADING or w[0].isdigit()):
            w = w[1:]
        w = [w[0], *[x for x in w[1:] if x not in HYBRID]] if w else w
        if not w:
            continue
        # as many words as the longest name has, and one more for a word typed as two
        heads = [" ".join(w[:n]) for n in range(min(len(w), trie.longest + 1), 0, -1)]
        for h in heads:
            got = _best([(0, *e, h) for e in trie.exact.get(h, ())], h)
            if got:
                return got[1], 0
        rest = set(w[1:])
        if not rest or (w[1] in GENUS_ONLY):
            found = [f for f in trie.search(w[0], min(2, distance_for(len(w[0])))) if f[2] == "genus"]
            near = {f[1] for f in found if f[0] == found[0][0]} if found else set()
            if len(near) == 1:
                return near.pop(), found[0][0]
            if rest:
                continue
        options = []
        for h in heads:
            for most in range(1, distance_for(len(h)) + 1):
                got = _best(trie.search(h, most), h)
                if got:
                    options.append((got[0], -len(h), got[1]))
                    break
        if options:
            d, _, entry = min(options)
            return entry, d
    return None


def _reference_rows(reference: DataFrame) -> list[tuple]:
    """The reference list in a fixed order; more than REFERENCE_MOST rows raise, since each worker holds the trie."""
    ref = reference.where(F.col("taxon_id").isNotNull()).select("taxon_id", "scientific_name", "genus", "common_name", "other_names", "taxon_rank").distinct()
    return sorted((tuple(r) for r in bounded_collect(ref, REFERENCE_MOST, "reference list")), key=lambda r: tuple((x is None, x) for x in r))


def matcher(rows: list[tuple]):
    """pandas UDF: text -> struct(entry, distance); the trie is built once per worker, repeated texts are kept."""
    cache: dict[str, object] = {}

    @F.pandas_udf("struct<entry:bigint,distance:int>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if "find" not in cache:
            trie = reference_trie(rows)
            cache["trie"], cache["find"] = trie, lru_cache(200_000)(lambda t: match_text(trie, t))
        for s in batches:
            got = [(cache["find"](t) if len(t) <= KEPT_LENGTH else match_text(cache["trie"], t)) if isinstance(t, str) and t.strip() else None for t in s]
            yield pd.DataFrame({"entry": pd.array([g[0] if g else None for g in got], dtype="Int64"), "distance": pd.array([g[1] if g else None for g in got], dtype="Int32")})

    return match


def _text(c: Column) -> Column:
    return F.when(F.btrim(c, F.lit(" \t\r\n\u00a0")) != "", c)


def entries_within(texts: DataFrame, text: Column, reference: DataFrame) -> DataFrame:
    """(text, entry, distance): for each distinct non-blank text all entries with a name or alias path (whole names,
    turned, short) within the length-dependent distance of the whole folded text, at their least distance.

    Nothing is chosen or cut off: ties and farther entries come out too. An empty side gives no rows."""
    rows = _reference_rows(reference)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = reference_trie(rows)
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                key = " ".join(words(t))
                best: dict = {}
                for d, e, kind, _ in trie.search(key, distance_for(len(key))) if key else ():
                    if kind != "genus":
                        best.setdefault(e, d)
                out += [(t, e, d) for e, d in best.items()]
            yield pd.DataFrame(out, columns=["text", "entry", "distance"])

    return texts.select(_text(text).alias("text")).where("text is not null").distinct().mapInPandas(search, "text string, entry long, distance int")


def canonical_entries(records: DataFrame, key: Column, texts: list[str], reference: DataFrame) -> DataFrame:
    """(key, entry, distance, matched_from): per key the entry meant by the first text column that means one, else 0.

    Keys without any text are left out. Every text of a key delivered more than once is tried: within a column the
    nearest entry wins, then the smallest. Rows are matched where they lie and only (key, entry) is shuffled, combined
    on the map side, so a key with a third of all rows is no hot spot. The whole reference list is one trie on each
    worker (REFERENCE_MOST rows at most), so its size changes no rule. An empty reference gives 0 for all.
    """
    match = matcher(_reference_rows(reference))
    some = records.select(key.alias("key"), *[_text(F.col(c)).alias(f"t{i}") for i, c in enumerate(texts)])
    some = some.where(F.col("key").isNotNull() & F.coalesce(*[f"t{i}" for i in range(len(texts))]).isNotNull())
    got = some.select("key", *[match(f"t{i}").alias(f"m{i}") for i in range(len(texts))])
    first = F.coalesce(*[F.when(F.col(f"m{i}.entry").isNotNull(), F.struct(F.lit(i).alias("at"), F.col(f"m{i}.distance").alias("distance"), F.col(f"m{i}.entry").alias("entry"))) for i in range(len(texts))])
    best = got.groupBy("key").agg(F.min(first).alias("b"))
    return best.select("key", F.coalesce("b.entry", F.lit(0)).cast("long").alias("entry"), "b.distance", F.get(F.array(*[F.lit(c) for c in texts]), F.col("b.at")).alias("matched_from"))


def unmatched_texts(records: DataFrame, entries: DataFrame, texts: list[str]) -> DataFrame:
    """The texts of keys without an entry, with their number of keys."""
    r = records.withColumn("key", plain_id("tree_id")).select("key", *texts).distinct()
    miss = r.join(entries.where("entry = 0").select("key"), "key", "left_semi")
    return miss.groupBy(*texts).agg(F.count_distinct("key").alias("n_keys"))
