"""A public byte-level tokenizer read from a vocabulary file whose folder is a parameter."""

from __future__ import annotations

import base64
import os

import numpy as np

FOLDER = "/opt/tokenizers"
FILE = "byte_bpe_50k.tiktoken"
#: fixed value: the published pattern that splits text before the merges of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, tuple] = {}


def encoder(folder: str = FOLDER):
    """(encoding, byte length of each token); loaded once per process."""
    if folder not in _loaded:
        import tiktoken

        with open(os.path.join(folder, FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _loaded[folder] = (enc, size)
    return _loaded[folder]
