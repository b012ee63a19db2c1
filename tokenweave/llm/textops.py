"""Vectorised text primitives shared by the corpus operators.

Everything here works on Arrow string columns inside ``mapInArrow`` and never
builds a Python object per word unless the caller asks for one.  Words are the
maximal runs of bytes outside ``0x20, 0x09-0x0D`` -- the pattern
``[^\\x20\\x09-\\x0D]+`` -- and a word never crosses a row boundary.

Identity of words and word windows is carried by 64-bit hashes.  A hash mixes a
random 64-bit value per byte with a random odd multiplier per position, so two
different words agree with probability about 2**-58.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: UTF-8 bytes handled at a time; bounds the size of every temporary array.
CHUNK_BYTES = 2_000_000

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply), applied element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = _stream(256, 7)
_position_factor = _stream(64, 1 << 32) | _U(1)


def _factors(n: int) -> np.ndarray:
    global _position_factor
    if n > len(_position_factor):
        _position_factor = _stream(2 * n, 1 << 32) | _U(1)
    return _position_factor


@dataclass
class Words:
    """Words of a run of rows: byte spans, 64-bit hashes, and row boundaries.

    ``first[r] : first[r + 1]`` are the words of row ``r``; ``start``/``end``
    index ``data``.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row may exceed it alone)."""
    if isinstance(column, pa.ChunkedArray):
        raise TypeError("chunks() takes an Array, not a ChunkedArray")
    n = len(column)
    if not n:
        return
    offsets = _offsets(column)
    begin = 0
    while begin < n:
        stop = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        stop = min(max(stop, begin + 1), n)
        yield begin, stop
        begin = stop


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(column).astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    """Split every row of a string column into words and hash them."""
    data, offsets = raw(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    opens[edges] = solid[edges]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    before = edges[edges > 0] - 1
    closes[before] = solid[before]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    value = np.zeros(0, np.uint64)
    if hashes:
        value = span_hashes(data, start, end)
    return Words(data, start, end, value, first)


#: Bytes of words hashed at a time; a longer word is hashed alone.
_HASH_BYTES = 4_000_000


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, ascending byte spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.cumsum(end - start)
    if total[-1] <= _HASH_BYTES:
        return _span_hashes(data, start, end)
    out, b = np.empty(len(start), np.uint64), 0
    while b < len(start):
        before = int(total[b - 1]) if b else 0
        e = max(b + 1, int(np.searchsorted(total, before + _HASH_BYTES, side="right")))
        out[b:e] = _span_hashes(data, start[b:e], end[b:e])
        b = e
    return out


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum()), dtype=np.int64)
    at = within + np.repeat(start - first, length)
    within -= np.repeat(first, length)
    value = _BYTE_VALUE[data[at]] * _factors(int(length.max()) + 1)[within]
    total = np.add.reduceat(value, first)
    return mix64(total + length.astype(np.uint64))


_BASE = _U(0x5851F42D4C957F2D)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-long windows of a hash sequence (rolling, mod 2**64).

    Row boundaries are the caller's concern: entry ``i`` covers
    ``hashes[i : i + size]``.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 6:
        total = np.zeros(n, np.uint64)
        factor = 1
        for k in range(size):
            total += hashes[k : k + n] * _U(factor)
            factor = factor * int(_BASE) % (1 << 64)
        return mix64(total)
    power = _powers(len(hashes))
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[0][: len(hashes)], out=prefix[1:])
    return mix64((prefix[size:] - prefix[:-size]) * power[1][:n])


def span_sequence_hashes(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the sequences ``hashes[f : f + n]``; equal sequences have equal hashes."""
    power = _powers(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[0][: len(hashes)], out=prefix[1:])
    return mix64((prefix[first + size] - prefix[first]) * power[1][first] + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_power_table: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power_table
    if _power_table is None or len(_power_table[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _power_table = np.cumprod(up), np.cumprod(down)
    return _power_table


def full_windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that stay inside a row, and the row of each."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][row] + inside, row


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingle hashes per row: (sorted values, row bounds).

    A row with fewer words gives its whole sequence as one shingle; a row
    without words gives none.
    """
    at, row = full_windows(w.first, size)
    value = window_hashes(w.hash, size)[at] if len(at) else np.zeros(0, np.uint64)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([sequence_hash(w.hash[w.first[r] : w.first[r + 1]], size) for r in short], np.uint64)
        value, row = np.concatenate([value, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(count) + 1))
    value = value.copy()
    for begin, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[begin:stop].sort()
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[keep], row[keep]
        bounds = np.searchsorted(row, np.arange(len(count) + 1))
    return value, bounds


def sequence_hash(hashes: np.ndarray, size: int) -> np.uint64:
    """Hash of one short word sequence; its length keeps it apart from windows."""
    total = _U(0)
    with np.errstate(over="ignore"):
        for h in hashes:
            total = total * _BASE + h
        return mix64(np.array([total + _U(len(hashes)) * _U(0xD6E8FEB86659FD93) + _U(size)], np.uint64))[0]


def signed(x: np.ndarray) -> np.ndarray:
    """View of unsigned 64-bit values as the signed longs that Spark stores."""
    return x.view(np.int64)
