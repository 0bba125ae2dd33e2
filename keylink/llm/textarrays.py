"""Texts of an Arrow batch as flat byte and word arrays, hashed without a Python loop.

A batch is cut into chunks of whole documents of about ``CHUNK_BYTES``, which bounds the memory of
the arrays; a document longer than that is a chunk of its own. Hashes are polynomials over 64-bit
integers with odd bases, finished by a mixing step, so any window's hash comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64

# White space between words: 0x20 and 0x09 to 0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, start: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    return mix(np.arange(start + 1, start + n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_BYTES = seeds(256, 1000)


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    def grow(b: int) -> np.ndarray:
        out = np.full(1 << bits, b, dtype=_U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return grow(base), grow(pow(base, -1, 1 << 64))


def window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0):
    """Hashes of values[starts[i]:ends[i]]; equal slices have equal hashes wherever they lie."""
    up, down = _powers(_BASES[which], max(10, int(len(values)).bit_length()))
    prefix = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


@dataclass
class Chunk:
    """Documents lo..hi-1 of a batch: their bytes in a row, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @cached_property
    def word_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        inside = ~WHITE[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before, after = cut[:n].copy(), cut[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1

    @cached_property
    def first_word(self) -> np.ndarray:
        """Where each document's words begin; one entry more than there are documents."""
        return np.searchsorted(self.word_bounds[0], self.offsets)

    def word_hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return window_hashes(_BYTES[data], *self.word_bounds, which)

    def shingles(self, k: int, hashes: np.ndarray, whole: bool, which: int = 0):
        """Hashes of k words in a row, and their document; whole: shorter documents give one."""
        counts = np.diff(self.first_word)
        n = np.maximum(counts - k + 1, 0)
        width = np.full(len(counts), k)
        if whole:
            short = (counts > 0) & (counts < k)
            n, width = np.where(short, 1, n), np.where(short, counts, k)
        doc, at = spread(n)
        start = self.first_word[doc] + at
        return window_hashes(hashes, start, start + width[doc], which), doc, at


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): groups (0, 0, 2, 2, 2) and places within them (0, 1, 0, 1, 2)."""
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - begin[group]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column with counts[i] of the values in row i."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    if kind == pa.int64():
        values = values.astype(np.uint64).view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))
