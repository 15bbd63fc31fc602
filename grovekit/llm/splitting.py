"""Splitting oversized texts at natural boundaries.

Recursive bisection over token boundaries: a stretch that is too long is cut at the strongest boundary near its
middle (paragraph, sentence, word, else any character), halves are handled alike until they fit the limit less
the overlap, then every piece but the first gets the last tokens before it in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.tokens import FOLDER, encoder

LIMIT, OVERLAP = 2048, 64
PARAGRAPH = re.compile(rb"\r?\n[ \t]*\r?\n\s*")
#: the ideographic full stop is three bytes and needs no blank after it
SENTENCE = re.compile(rb"(?:[.!?][\"')\]]*\s+|\xe3\x80\x82[\"')\]]*\s*)|\r?\n")
SPACE = re.compile(rb"\s+")


def boundaries(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Strength of a cut after each token: 3 paragraph, 2 sentence, 1 word, 0 character, -1 inside a character."""
    n = len(data)
    strength = np.zeros(n + 1, dtype=np.int8)
    raw = np.frombuffer(data, dtype=np.uint8)
    strength[:n][(raw & 0xC0) == 0x80] = -1
    for level, pattern in ((1, SPACE), (2, SENTENCE), (3, PARAGRAPH)):
        for m in pattern.finditer(data):
            # a token takes the blank before its word: the cut may stand on either side of the white space
            for at in (m.end(), m.end() - (data[m.end() - 1] == 32), m.start() if level == 1 else m.end()):
                if strength[at] >= 0:
                    strength[at] = max(strength[at], level)
    return strength[ends]


def cut_points(strength: np.ndarray, most: int) -> list[int]:
    """Token numbers at which pieces end so that none is longer than `most` tokens."""
    n, out, todo = len(strength), [], [(0, len(strength))]
    while todo:
        s, e = todo.pop()
        if e - s <= most:
            out.append(e)
            continue
        mid = (s + e) // 2
        at = None
        widths = ((e - s) // 4, (e - s) // 2 + 1)
        for width in widths:
            lo, hi = max(s + 1, mid - width), min(e - 1, mid + width)
            if hi < lo:
                continue
            part = strength[lo - 1 : hi]  # entry i tells the cut after token i
            best = part.max()
            if best > 0 or (best == 0 and width == widths[-1]):
                i = np.flatnonzero(part == best)
                at = int(lo + i[np.argmin(np.abs(lo + i - mid))])
                break
        if at is None:  # only cuts inside a character are left between s and e
            out.append(e)
            continue
        todo += [(at, e), (s, at)]
    return sorted(x for x in set(out) if 0 < x <= n)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = FOLDER) -> list[tuple[str, int, int, int, int]]:
    """(piece, tokens, shared tokens, first character, end character) of a text longer than limit; [] otherwise.

    A piece's own tokens are counted anew. A cut inside a word can add a token or two; a piece that so exceeds the
    limit is cut once more in its middle, until every piece fits. A limit too small for a single character beside
    its overlap raises ValueError rather than return an oversized piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    enc, size = encoder(folder)
    ids = enc.encode_ordinary(text)
    if len(ids) <= limit:
        return []
    data = text.encode("utf-8", "surrogatepass")
    ends = np.cumsum(size[np.array(ids)])
    strength = boundaries(data, ends)
    todo = [*reversed(list(pairwise([0, *cut_points(strength, limit - overlap)])))]
    out: list[tuple[str, int, int, int, int]] = []
    while todo:
        start, end = todo.pop()
        front = max(0, start - overlap)
        a, z = (int(ends[i - 1]) if i else 0 for i in (front, end))
        while a > 0 and (data[a] & 0xC0) == 0x80:  # never begin inside a character
            front -= 1
            a = int(ends[front - 1]) if front else 0
        piece = data[a:z].decode("utf-8", "surrogatepass")
        n = len(enc.encode_ordinary(piece))
        if n > limit:
            inner = [i for i in range(start + 1, end) if strength[i - 1] >= 0]
            if not inner:
                raise ValueError("no cut between characters fits the limit")
            best = max(inner, key=lambda i: (strength[i - 1] if abs(2 * i - start - end) <= (end - start) // 2 else -1, -abs(2 * i - start - end)))
            todo += [(best, end), (start, best)]
            continue
        first = out[-1][4] - len(data[a : int(ends[start - 1])].decode("utf-8", "surrogatepass")) if out else 0
        out.append((piece, n, start - front, first, first + len(piece)))
    return out


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = FOLDER, id_col: str = "doc_id") -> DataFrame:
    """(id, piece_no, n_pieces, piece, n_tokens, shared_tokens, char_from, char_to) of the texts above the limit.

    A text of at most `limit` bytes has at most as many tokens and is left out without counting. Texts at or
    under the limit, empty and null ones give no rows; repeated rows give their pieces repeatedly.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"]):
                got = split_text(t, limit, overlap, folder)
                out += [(i, k, len(got), *p) for k, p in enumerate(got)]
            yield pd.DataFrame(out, columns=["id", "piece_no", "n_pieces", "piece", "n_tokens", "shared_tokens", "char_from", "char_to"])

    long_ = documents.where(F.octet_length("text") > limit).select(F.col(id_col).alias("id"), "text")
    kind = documents.schema[id_col].dataType.simpleString()
    out = long_.mapInPandas(pieces, f"id {kind}, piece_no int, n_pieces int, piece string, n_tokens int, shared_tokens int, char_from int, char_to int")
    return out.withColumnRenamed("id", id_col)
