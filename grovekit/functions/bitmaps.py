"""Compressed bitmaps over 32-bit ordinals, NumPy only.

An ordinal's high 16 bits choose a container; a container is a sorted array of low halves while it is small
and a packed bit field above that, so sparse and dense stretches both stay compact.
"""

from __future__ import annotations

import numpy as np

ARRAY_MOST = 4096


def _pack(low: np.ndarray) -> np.ndarray:
    if low.size <= ARRAY_MOST:
        return low.astype(np.uint16)
    bits = np.zeros(65536, dtype=bool)
    bits[low] = True
    return np.packbits(bits)


def _low(container: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(container)) if container.dtype == np.uint8 else container.astype(np.int64)


class Bitmap:
    """A set of ordinals; supports AND, AND-NOT and listing in order."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> "Bitmap":
        ordinals = np.unique(np.asarray(ordinals, dtype=np.int64))
        high = ordinals >> 16
        keys, starts = np.unique(high, return_index=True)
        return cls({int(k): _pack(part & 0xFFFF) for k, part in zip(keys, np.split(ordinals, starts[1:]))})

    def _with(self, other: "Bitmap", keep: bool) -> "Bitmap":
        out = {}
        for k, a in self.containers.items():
            b = other.containers.get(k)
            if b is None:
                if not keep:
                    out[k] = a
                continue
            if a.dtype == np.uint8 and b.dtype == np.uint8:
                both = a & (b if keep else ~b)
                if both.any():
                    out[k] = _pack(np.flatnonzero(np.unpackbits(both)))
                continue
            low = _low(a)
            low = low[np.isin(low, _low(b), assume_unique=True, invert=not keep)]
            if low.size:
                out[k] = _pack(low)
        return Bitmap(out)

    def and_(self, other: "Bitmap") -> "Bitmap":
        return self._with(other, True)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        return self._with(other, False)

    def ordinals(self) -> np.ndarray:
        parts = [_low(c) + (k << 16) for k, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)

    def __len__(self) -> int:
        return int(sum(np.unpackbits(c).sum() if c.dtype == np.uint8 else c.size for c in self.containers.values()))
