"""Evaluation texts leaking into training text.

The test items form a BM25 inverted index with block-max impacts. Every passage of every document is a query; blocks of items
whose summed maxima stay under the threshold are skipped, the postings of the others are scored, all items above
their threshold are retrieved, and the overlap is then verified word by word.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.session import bounded_collect, union_all

ITEMS_MOST = 1_000_000
#: items in one index, and in one scan of the corpus, which holds several indexes in each worker
INDEX_ITEMS, ITEMS_AT_ONCE = 2_000, 20_000
K1, B = 1.2, 0.75
POSTINGS_BLOCK = 16
#: share of an item that must be there in one stretch, of whose words every ERROR_EVERYth may be mistyped
SHARE, ERROR_EVERY = 0.5, 3
#: words split or run together by layout: so many in any stretch, and one in so many words of an item
LAYOUT_LEAST, LAYOUT_EVERY = 3, 16
TOKEN = re.compile(r"[^\W_]+")
INLINE = re.compile(r"</?(?:i|b|em|strong|u|span|a|code|mark|sub|sup|small|font|s|tt)\b[^<>]*>", re.I)
MARKS = re.compile("[\u0300-\u036f]+")
TAG = re.compile(r"<[^<>]{1,200}>")
#: fixed values: characters that typesetting puts into words
DROPPED = dict.fromkeys(map(ord, "'’‘`´*_~­​‌‍﻿"))


def normal_words(text: str) -> list[str]:
    """Words of a text without case, markup, accents and punctuation."""
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    return TOKEN.findall(text.translate(DROPPED).casefold())


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


@lru_cache(100_000)
def like(a: str, b: str) -> bool:
    most = 2 if min(len(a), len(b)) >= 5 else 1
    return edits(a, b, most) <= most


class Item:
    def __init__(self, item_id: int, text: str):
        self.id, self.words, self.unit = item_id, [], []
        n = 0
        for piece in re.split(r"\s+", text.strip()):
            w = normal_words(piece)
            self.words += w
            self.unit += [n] * len(w)
            n += bool(w)
        self.n_units = n
        self.pairs: dict[int, list[int]] = {}
        self.pairs_least = 0.0

    def number(self, term: dict[str, int]) -> None:
        """Places of its pairs of neighbouring words, a pair being one number."""
        ids = [term[w] for w in self.words]
        for j, (a, b) in enumerate(zip(ids, ids[1:])):
            self.pairs.setdefault(a << 32 | b, []).append(j)
        # the fewest distinct pairs that a stretch of half the item keeps if no error is nearer than ERROR_EVERY to
        # the next: one pair in ERROR_EVERY at least, less those that occur twice
        need = max(1, int(len(ids) * SHARE) - 1)
        twice = len(ids) - 1 - len(self.pairs)
        self.pairs_least = max(1, (need - 1) * (ERROR_EVERY - 2) // ERROR_EVERY - twice)


class ItemIndex:
    """BM25 impacts of the items' terms divided by the item's threshold, so that 1 is the threshold of all."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items = [i for i in (Item(a, b) for a, b in rows if b) if i.words]
        n = max(1, len(self.items))
        df = Counter(w for i in self.items for w in set(i.words))
        idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
        mean = sum(len(i.words) for i in self.items) / n
        post: dict[str, list[tuple[int, float]]] = {}
        self.longest = max((len(i.words) for i in self.items), default=1)
        for k, item in enumerate(self.items):
            tf = Counter(item.words)
            norm = K1 * (1 - B + B * len(item.words) / mean)
            impact = {w: idf[w] * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            theta = self._least(item, impact)
            for w, v in impact.items():
                post.setdefault(w, []).append((k, v / theta))
        # term 0 is every word that no item holds
        self.term = {w: k for k, w in enumerate(sorted(post), 1)}
        self.pair_items: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            item.number(self.term)
            for pair in item.pairs:
                self.pair_items.setdefault(pair, []).append(k)
        self.pairs_least = min((i.pairs_least for i in self.items), default=1)
        # per block of items the largest impact of each term, and its postings as one small matrix, so that a block
        # under the threshold is skipped without touching them
        self.n_blocks = len(self.items) // POSTINGS_BLOCK + 1
        self.block = np.zeros((len(post) + 1, self.n_blocks), dtype=np.float32)
        held: list[dict[int, np.ndarray]] = [{} for _ in range(self.n_blocks)]
        for w in sorted(post):
            t = self.term[w]
            for k, v in post[w]:
                held[k // POSTINGS_BLOCK].setdefault(t, np.zeros(POSTINGS_BLOCK))[k % POSTINGS_BLOCK] = v
        self.place = np.zeros((len(post) + 1, self.n_blocks), dtype=np.int32)
        rows = [np.zeros(POSTINGS_BLOCK)]
        for b, of in enumerate(held):
            for t, v in sorted(of.items()):
                self.place[t, b] = len(rows)
                self.block[t, b] = np.float32(v.max()) * np.float32(1.00001)
                rows.append(v)
        self.impacts = np.array(rows)
        self.top = self.block.max(axis=1).astype(np.float64)
        # a stretch of half the longest item lies whole inside some passage
        half = int(math.ceil(self.longest * SHARE)) + 16
        self.stride = max(32, half)
        self.passage = self.stride + half

    @staticmethod
    def _least(item: Item, impact: dict[str, float]) -> float:
        """Lowest score of an unbroken half of the item whose dearest words, one in ERROR_EVERY, are mistyped."""
        n, need = len(item.words), max(1, int(len(item.words) * SHARE) - 1)
        wrong = -(-need // ERROR_EVERY) if need >= ERROR_EVERY else 0
        best = math.inf
        for s in range(n - need + 1):
            v = sorted((impact[w] for w in set(item.words[s : s + need])), reverse=True)
            best = min(best, sum(v[wrong:]) or v[-1])
        return max(1e-9, best * 0.9999)

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """(item number, score) of all items with a score of at least 1 for distinct terms.

        The maxima of the terms in each block of items are added up first; only blocks whose bound reaches the
        threshold have their postings read.
        """
        alive = np.flatnonzero(self.block[terms].sum(axis=0) >= 1)
        if not alive.size:
            return []
        score = self.impacts[self.place[terms][:, alive]].sum(axis=0)
        return [(int(alive[b]) * POSTINGS_BLOCK + int(i), float(score[b, i])) for b, i in np.argwhere(score >= 1)]


def overlap(item: Item, words: list[str], pairs: list[int], at: list[int], lo: int, hi: int) -> float:
    """Largest share of the item's words found as one unbroken stretch that reaches into words[lo:hi], where `at` are the
    places of pairs that items hold, single mistyped words and words split or run together by layout allowed. A stretch is grown from each pair of neighbouring words.

    A stretch keeps the distance of its places in text and item but for words split or run together, so where no band
    of neighbouring distances holds the fewest pairs of half an item, nothing is grown."""
    w, n, best, seen = item.words, len(item.words), 0, set()
    seeds = [(p, q) for p in at for q in item.pairs.get(pairs[p], ())]
    if len(seeds) < item.pairs_least:
        return 0.0
    off = sorted(p - q for p, q in seeds)
    k, band = int(item.pairs_least) - 1, LAYOUT_LEAST + n // LAYOUT_EVERY
    if not any(b - a <= band for a, b in zip(off, off[k:])):
        return 0.0
    reach = n + 8
    lo, hi = max(0, lo - reach), min(len(words), hi + reach)

    def extend(p: int, q: int, step: int) -> tuple[int, int]:
        wrong = 0
        while 0 <= q < n and lo <= p < hi:
            if words[p] == w[q]:
                p, q, wrong = p + step, q + step, 0
                continue
            p2, q2 = p + step, q + step
            if lo <= p2 < hi and (words[p] + words[p2] if step > 0 else words[p2] + words[p]) == w[q]:
                p, q, wrong = p2 + step, q2, 0
            elif 0 <= q2 < n and (w[q] + w[q2] if step > 0 else w[q2] + w[q]) == words[p]:
                p, q, wrong = p2, q2 + step, 0
            elif wrong < 2 and like(words[p], w[q]):
                p, q, wrong = p2, q2, wrong + 1
            else:
                break
        return p, q

    for p, q in seeds:
        if (p - q, q) in seen:
            continue
        p1, q1 = extend(p, q, 1)
        _, q0 = extend(p - 1, q - 1, -1)
        seen.update((p - q, j) for j in range(q, q1))
        if q1 - q0 - 1 > max(2, best):
            full = Counter(item.unit[q0 + 1 : q1])
            whole = sum(1 for u, c in full.items() if c == item.unit.count(u))
            best = max(best, whole)
    return best / max(1, item.n_units)


def find_leaks(index: ItemIndex, words: list[str]) -> list[tuple[int, float, float]]:
    """(item id, share, score) of the items that leaked into a text of these words."""
    n = len(words)
    ids = np.fromiter(map(index.term.get, words, repeat(0)), dtype=np.int32, count=n)
    total = np.concatenate([[0.0], np.cumsum(index.top[ids])])
    starts = np.arange(0, max(1, n - index.passage + index.stride), index.stride)
    ends = np.minimum(n, starts + index.passage)
    some = total[ends] - total[starts] >= 1
    found: dict[int, tuple[float, float]] = {}
    if not some.any():
        return []
    pairs = (ids[:-1].astype(np.int64) << 32 | ids[1:]).tolist()
    held = [p for p, x in enumerate(pairs) if x in index.pair_items]
    for lo, hi in zip(starts[some].tolist(), ends[some].tolist()):
        at = held[bisect_left(held, lo) : bisect_left(held, hi - 1)]
        if len(at) < index.pairs_least:
            continue
        # a set is faster than sorting for so few terms
        hits = index.retrieve(np.fromiter(set(ids[lo:hi].tolist()), dtype=np.int64))
        if not hits:
            continue
        shared = Counter(k for x in {pairs[p] for p in at} for k in index.pair_items[x])
        for k, score in hits:
            item = index.items[k]
            if shared[k] < item.pairs_least or found.get(item.id, (0.0, 0.0))[0] >= 1:
                continue
            share = overlap(item, words, pairs, at, lo, hi)
            if share >= SHARE:
                found[item.id] = max(found.get(item.id, (0.0, 0.0)), (share, score))
    return [(i, s, c) for i, (s, c) in sorted(found.items())]


def leaked_items(documents: DataFrame, items: DataFrame, items_at_once: int = ITEMS_AT_ONCE, index_items: int = INDEX_ITEMS) -> DataFrame:
    """(doc_id, item_id, share, score) of the documents that hold at least half of an item in one stretch.

    Whole texts are searched, in one scan for items_at_once items, whose indexes of index_items each the workers
    hold; more items take further scans (ITEMS_MOST guards the driver). Null and empty texts and items give no rows; repeated
    rows of a document give one row per item.
    """
    rows = sorted(tuple(r) for r in bounded_collect(items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct(), ITEMS_MOST, "items"))
    docs = documents.where(F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    if not rows:
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("share"), F.lit(0.0).alias("score"))
    parts = []
    it = iter(rows)
    while block := list(islice(it, items_at_once)):
        parts.append(docs.mapInPandas(_searcher(block, index_items), "doc_id long, item_id long, share double, score double"))
    return union_all(parts).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("score").alias("score"))


def _searcher(items: list[tuple[int, str]], index_items: int):
    kept: list[ItemIndex] = []

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not kept:
            kept.extend(ItemIndex(items[lo : lo + index_items]) for lo in range(0, len(items), index_items))
        for pdf in batches:
            out = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                words = normal_words(t)
                out += [(d, *leak) for index in kept for leak in find_leaks(index, words)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "score"])

    return search
