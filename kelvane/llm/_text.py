"""Vectorised views of Arrow string columns: bytes, words, lines and rolling fingerprints.

All functions work on the contiguous bytes of a batch, so the cost is a few passes over the text and no
Python object is made for a word or a line. A fingerprint of bytes ``s..e`` is the difference of two prefix
sums of ``R[byte] * P**position`` modulo 2**64, shifted back by ``P**-s`` and mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``P**i`` and ``P**-i`` for i < n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, (1 << 19) + 1)
        inverse = pow(_P, -1, 2**64)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(m - 1, p, np.uint64))]) for p in (_P, inverse)]
    return _POWERS[0], _POWERS[1]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and their n + 1 offsets; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer text stands alone."""
    data, offsets = bytes_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z made lower case; other bytes stay."""
    return _LOWER[data]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the bytes starts[i]..ends[i]; equal bytes give equal values wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 21) -> np.ndarray:
    """``fingerprints`` of spans ordered by start; a long text is taken in runs of spans, so that tables of powers stay small."""
    if len(data) <= limit:
        return fingerprints(prefix_sums(data), starts, ends)
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + limit, side="right")))
        out[i:j] = fingerprints(prefix_sums(data[a : int(ends[j - 1])]), starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


class Words:
    """The words of a run of texts: byte starts and ends, their text's index, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, n = data, offsets, len(data)
        self.solid = solid = ~SPACE[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner], after[inner - 1] = False, False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words inside one text."""
        m = len(hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        q, total = 0xD6E8FEB86659FD93, np.zeros(m, np.uint64)
        for i in range(k):
            total = total * np.uint64(q) + hashes[i : i + m]
        return at, mix(total[at])


class Lines:
    """The \\n-split lines of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        cuts = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
        self.ends = np.sort(np.concatenate([cuts, offsets[1:]]))
        self.counts = np.diff(np.searchsorted(cuts, offsets)) + 1
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n).astype(np.int64)
