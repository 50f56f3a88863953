"""Vectorised text kernels on Arrow buffers: words, rolling hashes, window minima.

Hashes are polynomials modulo 2**64 over 64-bit symbols. Symbol i of a buffer
is weighted with BASE**i; a difference of prefix sums times BASE**-start is
then independent of where the run stands. ``mix`` spreads the result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Bytes of text that are worked on at once; the arrays take some 100 times as much.
CHUNK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _return_memory() -> None:
    """Lets the C library give large freed arrays back to the system at once; else a worker keeps what its largest text took."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: larger arrays have pages of their own
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


_return_memory()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that makes all bits depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U))
        have = _POWERS[base] = (made[0], made[1])
        if size > 8 * CHUNK:  # a very long text; do not keep its tables
            del _POWERS[base]
    return have[0][:n], have[1][:n]


class Rolling:
    """Hashes of runs [start, start + length) of a symbol array."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        weight, self.inverse = powers(base, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * weight[:n], dtype=U, out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, k: int) -> np.ndarray:
        """The hash of each run of k symbols, also those that cross documents."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return np.empty(0, U)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length rows + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes, one row at least: (first, last + 1, bytes, offsets)."""
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, index of each row's first word, one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word, by stretches of about ``CHUNK`` bytes, so that a long text takes no more than its words' hashes."""
    out = np.empty(len(starts), U)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, "right")))
        base = starts[first]
        out[first:last] = Rolling(data[base : ends[last - 1]].astype(U) + U(1)).runs(starts[first:last] - base, ends[first:last] - base)
        first = last
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether each run [a, a_end) has the bytes of the run [b, b_end), by stretches of some CHUNK bytes."""
    same = a_end - a == b_end - b
    ask = np.flatnonzero(same & (a != b))
    total = np.cumsum(a_end[ask] - a[ask])
    first = 0
    while first < len(ask):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CHUNK, "right")))
        mine = ask[first:last]
        left, off = gather(data, a[mine], a_end[mine])
        right, _ = gather(data, b[mine], b_end[mine])
        wrong = np.concatenate([[0], np.cumsum(left != right)])
        same[mine] = wrong[off[1:]] == wrong[off[:-1]]
        first = last
    return same


def exact_ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: hashes tell words apart, and bytes confirm."""
    _, lead, rank = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if not len(rank):
        return rank
    other = np.flatnonzero(~same_bytes(data, starts, ends, starts[lead[rank]], ends[lead[rank]]))
    if len(other):  # words of one hash: all but the first one's kind
        more: dict[bytes, int] = {}
        for i in other:
            rank[i] = len(lead) + more.setdefault(data[starts[i] : ends[i]].tobytes(), len(more))
    return rank


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step] if step else out, out[step:])
        have += step
    return out


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n items, given each row's first item (and the end)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.empty(0, np.int64)


def window_minima(symbols: np.ndarray, first: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, Rolling]:
    """For each window of ``size`` symbols in one row: its start, and the least hash of its k-grams.

    The least k-gram depends on the window alone, so equal windows share it.
    """
    n = len(symbols)
    rolling = Rolling(symbols, BASES[1])
    if n < size:
        return np.empty(0, np.int64), np.empty(0, U), rolling
    least = slide(rolling.every(k), size - k + 1, np.minimum)
    inside = np.ones(n - size + 1, bool)
    mark = np.zeros(n + 2, np.int32)  # windows that cross the end of a row
    ends = first[1:-1]
    ends = ends[(ends > 0) & (ends < n)]
    np.add.at(mark, np.maximum(ends - size + 1, 0), 1)
    np.add.at(mark, ends, -1)
    inside &= np.cumsum(mark)[: n - size + 1] == 0
    starts = np.flatnonzero(inside)
    return starts, least[starts], rolling


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies byte runs one after the other: (bytes, offsets)."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    index = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return data[index], off


def binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))]).cast(pa.binary())


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column whose row i holds values[first[i]:first[i + 1]] as little-endian bytes."""
    values = np.ascontiguousarray(values)
    return binary(values.view(np.uint8).reshape(-1), np.asarray(first, np.int64) * values.itemsize)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
