"""Vectorised helpers over Arrow text batches: byte chunks, words, polynomial hashes, union-find."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C13 | 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SYMBOL = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 20)
        _POWERS = np.full(size, _BASE, dtype=np.uint64)
        _INVERSES = np.full(size, _INVERSE, dtype=np.uint64)
        _POWERS[0] = _INVERSES[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
        np.multiply.accumulate(_INVERSES, out=_INVERSES)
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(column: pa.Array, budget: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column with their bytes: (first, last + 1, bytes, offsets from 0).

    Nulls count as empty. A chunk holds whole texts of about ``budget`` bytes together, so that the
    8-byte working arrays stay small; one longer text makes a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + budget, "right")) - 1))
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and per text the number of the first word (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < len(buf)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


class PrefixHash:
    """Polynomial hashes, modulo 2**64, of any stretch of a buffer after one pass."""

    def __init__(self, buf: np.ndarray):
        powers, self.inverses = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_SYMBOL[buf] * powers[: len(buf)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverses[starts])

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position that has so many."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverses[:n])


def freeing(run: Callable) -> Callable:
    """``run``, a map over Arrow batches, which gives memory back when its rows are through: workers live on
    and wait for other tasks, and what their allocators and the tables of powers keep adds up in an executor."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _POWERS, _INVERSES
        yield from run(batches)
        _POWERS = _INVERSES = _POWERS[:1].copy()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return wrapped


def find(parent: dict, x):
    root = x
    while (p := parent.get(root, root)) != root:
        root = p
    while (p := parent.get(x, x)) != root:
        parent[x] = root
        x = p
    return root


def unite(parent: dict, a, b) -> None:
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)
        parent.setdefault(min(a, b), min(a, b))
