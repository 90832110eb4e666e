"""Words of a batch of texts as numpy arrays: places and 64-bit hashes, computed for all bytes at once.

Runs inside mapInArrow tasks. A word is a maximal run of bytes other than space and U+0009 to U+000D, so a word never cuts
a multi-byte character. Word hashes are polynomial over salted bytes modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # keeps the arrays of a slice to a few MB
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word (one-to-one)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grown(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    a = np.full(n, base & (2**64 - 1), np.uint64)
    a[:1] = 1
    return np.multiply.accumulate(a)


class Slice:
    """Words of the rows lo..hi-1 of a batch; row numbers and byte offsets count from the slice's start."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, row, start, end, hashes):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.row, self.start, self.end, self.hash = row, start, end, hashes
        self.count = np.bincount(row, minlength=hi - lo).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])  # index of each row's first word

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words inside one row, and the index of each run's first word."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        base = (BASE + 2 * salt * 0x51ED2701F) & (2**64 - 1) | 5
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * grown(base, n))])
        at = np.flatnonzero(self.row[: n - size + 1] == self.row[size - 1 :])
        back = grown(pow(base, -1, 2**64), n)
        return mix((summed[at + size] - summed[at]) * back[at] + np.uint64(size + salt)), at


class Reader:
    """Cuts batches into slices of about SLICE_BYTES (a longer text is a slice of its own) and finds their words."""

    def __init__(self, fold_case: bool = False):
        byte = np.arange(256, dtype=np.uint64)
        self.is_word = ~((byte == 32) | ((byte >= 9) & (byte <= 13)))
        if fold_case:
            byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.salted = mix(byte * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x1234567))
        self.up = grown(BASE, 0)
        self.down = grown(BASE, 0)

    def slices(self, texts: pa.Array) -> Iterator[Slice]:
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            width = np.int64
        else:
            width = np.int32
        bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES, "right")) - 1)
            hi = min(hi, len(texts))
            yield self.slice(lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            lo = hi

    def slice(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> Slice:
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = grown(BASE, n), grown(pow(BASE, -1, 2**64), n)
        inside = self.is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[offsets < n]
        before[cuts] = False
        after[cuts[cuts > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        summed = np.zeros(n + 1, np.uint64)
        np.cumsum(self.salted[data] * self.up[:n], out=summed[1:])
        hashes = mix((summed[end] - summed[start]) * self.down[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
        return Slice(lo, hi, data, offsets, np.searchsorted(offsets, start, "right") - 1, start, end, hashes)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each row's bytes."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """Arrow lists from values sorted by row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
