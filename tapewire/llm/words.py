"""Words and hashed word windows of whole Arrow string batches, without a Python loop over words.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return.  Texts are handled in slices of about ``SLICE`` bytes (a longer text is a slice of its
own), so memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_MIX = np.random.Generator(np.random.PCG64(20240)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX_LOWER = _MIX[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer slice comes."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE + 65536)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and the n + 1 offsets into them (starting at 0)."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


@dataclass
class Words:
    """Words of the texts ``first`` to ``first + n_docs - 1`` of a column."""

    first: int
    raw: np.ndarray  # bytes of the slice
    starts: np.ndarray  # of each word
    ends: np.ndarray
    bounds: np.ndarray  # n_docs + 1 word numbers
    text_bounds: np.ndarray  # n_docs + 1 byte positions
    hashes: np.ndarray | None

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1


def _cut(raw: np.ndarray, offsets: np.ndarray, first: int, lower: bool, hashed: bool) -> Words:
    n = len(raw)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Words(first, raw, zero, zero, np.zeros(len(offsets), np.int64), offsets, np.zeros(0, np.uint64) if hashed else None)
    space = _SPACE[raw]
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begin[heads] = word[heads]
    end = word.copy()
    end[:-1] &= space[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] = word[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = None
    if hashed:
        up, down = _power_tables(n)
        value = (_MIX_LOWER if lower else _MIX)[raw]
        value *= up[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(first, raw, starts, ends, np.searchsorted(starts, offsets), offsets, hashes)


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, hashed: bool = True, limit: int = SLICE) -> Iterator[Words]:
    raw, offsets = buffers(as_strings(column))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield _cut(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, lower, hashed)
        i = j


def prefix_hashes(raw: np.ndarray):
    """A function of positions and a length: hashes of that many lower-cased bytes from each position."""
    up, down = _power_tables(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_MIX_LOWER[raw] * up[: len(raw)], out=total[1:])
    return lambda at, k: mix64((total[at + k] - total[at]) * down[at] + np.uint64(k << 40))


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """One hash for each ``size`` consecutive words, across text borders too."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size + (seed << 8)))
    for k in range(size):
        out *= _STEP
        out += hashes[k : k + n]
    return mix64(out)


def sequence_hash(hashes: np.ndarray, seed: int = 0) -> np.uint64:
    """The hash of a whole sequence; equals the window hash of that length."""
    return window_hashes(hashes, len(hashes), seed)[0]


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Word numbers at which a window lies within one text."""
    counts = np.diff(bounds)
    keep = np.ones(int(bounds[-1]), bool)
    for back in range(1, size):
        at = bounds[1:] - back
        keep[at[(counts >= back)]] = False
    return np.flatnonzero(keep)


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a shorter text is one shingle, an empty one none."""
    windows = window_hashes(w.hashes, size)
    out = []
    for lo, hi in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            x = np.sort(windows[lo : hi - size + 1])
            out.append(x if len(x) < 2 or (x[1:] != x[:-1]).all() else x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif hi > lo:
            out.append(np.array([sequence_hash(w.hashes[lo:hi])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(values: np.ndarray, seed: int = 0) -> np.uint64:
    """An order-free 64-bit key of a set of hashes."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix64(values + np.uint64(2 * seed + 1)), dtype=np.uint64) if len(values) else np.uint64(0)
        return mix64(np.array([total * np.uint64(31) + np.uint64(len(values))], np.uint64))[0]
