"""Numpy views of Arrow text columns: byte runs, words, and 64-bit hashes of any run.

Everything works on slices of whole documents of about ``SLICE`` bytes, so that the working
arrays stay small whatever the batch holds; one longer document is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 500_000
#: Blocks that are mixed at once.
BLOCKS = 200_000
#: ASCII white space: the bytes that part words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The lowest k bytes of a word, k = 0 to 8.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * M1
    h ^= h >> np.uint64(27)
    h *= M2
    h ^= h >> np.uint64(31)
    return h


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; null is the empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def give_back() -> None:
    """Return what a worker, which is kept for other tasks, no longer uses."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it
    pa.default_memory_pool().release_unused()


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _tiled(starts: np.ndarray, size: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ``unit`` places that tile each run, the last one moved back to end with it: places, numbers, first block of each."""
    n = -(-size // unit)
    number = ragged(np.zeros(len(n), np.int64), n)
    at = np.repeat(starts, n) + np.minimum(number * unit, np.repeat(size - unit, n))
    return at, number, np.concatenate(([0], np.cumsum(n)[:-1]))


def _portions(runs: np.ndarray, size: np.ndarray, unit: int) -> Iterator[np.ndarray]:
    """``runs`` in portions of about BLOCKS blocks each."""
    if len(runs):
        total = np.cumsum(size[runs] // unit + 1)
        yield from np.split(runs, np.searchsorted(total, np.arange(BLOCKS, int(total[-1]), BLOCKS)))


class Runs:
    """Digests of any runs of a byte array, equal for equal runs wherever they lie.

    A run is cut into words of eight bytes. Each is mixed with its number in the run and the mixed words
    are added; a run of eight bytes or fewer is its own bytes, mixed with its length. Nothing in it is
    linear in the bytes, and digests of different salts are independent.
    """

    def __init__(self, data: np.ndarray, salt: int = 0):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        #: The eight bytes from each place on, zeros beyond the end.
        self.eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).copy()
        self.salt = np.uint64(salt)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = mix((self.eight[starts] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * M1 + self.salt)
        for long in _portions(np.flatnonzero(size > 8), size, 8):
            at, number, first = _tiled(starts[long] + 8, size[long] - 8, 8)
            v = mix(self.eight[at] ^ (number.astype(np.uint64) * _STEP + self.salt + M2))
            h[long] = mix(h[long] + np.add.reduceat(v, first))
        return h

    def grams(self, width: int) -> np.ndarray:
        """Digests of the ``width`` bytes (9 to 16) from each place on that has so many."""
        n = len(self.eight) - width
        return mix(self.eight[:n] * M1 + self.eight[width - 8 : width - 8 + n] + self.salt)

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the runs of ``size`` bytes from ``a`` and from ``b`` on hold the same bytes."""
        low = _LOW[np.minimum(size, 8)]
        ok = (self.eight[a] & low) == (self.eight[b] & low)
        for long in _portions(np.flatnonzero(ok & (size > 8)), size, 8):
            at, _, first = _tiled(a[long], size[long], 8)
            n = np.diff(np.concatenate((first, [len(at)])))
            ok[long] = np.logical_and.reduceat(self.eight[at] == self.eight[at + np.repeat(b[long] - a[long], n)], first)
        return ok


class Sequence:
    """The same over an array of 64-bit symbols: each level mixes pairs of neighbouring blocks into one."""

    def __init__(self, symbols: np.ndarray, salt: int = 0):
        self.one = mix(symbols + np.uint64(salt))
        self.many = self.one
        for half in (1, 2, 4):
            beside = np.zeros_like(self.many)
            beside[:-half or None] = self.many[half:]
            self.many = mix(self.many * M1 + beside)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h = np.zeros(len(size), dtype=np.uint64)
        for unit, level, mine in ((1, self.one, np.flatnonzero((size > 0) & (size < 8))), (8, self.many, np.flatnonzero(size >= 8))):
            for mine in _portions(mine, size, unit):
                at, number, first = _tiled(starts[mine], size[mine], unit)
                h[mine] = np.add.reduceat(mix(level[at] ^ (number.astype(np.uint64) * _STEP)), first)
        return mix(h + size.astype(np.uint64) * M1)


def chained(symbols: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Digests of ``width`` symbols (at least one) from each start on."""
    h = mix(symbols[starts])
    for k in range(1, width):
        h = mix(h * M1 + symbols[starts + k])
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document counts of the words of the documents cut at ``offsets``."""
    full = ~_IS_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = full[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = full[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    nonempty = offsets[1:] > offsets[:-1]
    before[first[nonempty]] = False
    after[last[nonempty]] = False
    starts = np.flatnonzero(full & ~before)
    ends = np.flatnonzero(full & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def blocks(eight: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all runs in blocks of eight, the last one of each filled up with zeros; blocks in each), of ``Runs.eight``."""
    n = -(-size // 8)
    number = ragged(np.zeros(len(n), np.int64), n)
    return eight[np.repeat(starts, n) + 8 * number] & _LOW[np.minimum(np.repeat(size, n) - 8 * number, 8)], n


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the runs of ``data`` between consecutive offsets."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).astype(np.uint64, copy=False).view(np.int64))
