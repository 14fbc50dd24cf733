"""Words of whole Arrow batches of texts, found and hashed with array operations."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

#: Odd, so that its powers have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value starts (one more than values)."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Runs of bytes that inside() marks, split at text borders: start, end and text of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.raw = raw
        flag = inside[raw]
        before = np.empty_like(flag)
        before[:1] = False
        before[1:] = flag[:-1]
        first = offsets[:-1][offsets[:-1] < len(raw)]
        starts = flag & ~before
        starts[first] |= flag[first]
        after = np.empty_like(flag)
        after[-1:] = False
        after[:-1] = ~flag[1:] | starts[1:]
        after[-1:] = True
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(flag & after) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=total[1:]) if len(raw) else None
        self._total = total

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `most` bytes."""
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        h = (self._total[end] - self._total[self.start]) * powers(BASE_INVERSE, len(self.raw) + 1)[self.start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))
