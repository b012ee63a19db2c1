"""One-bit and multi-bit codes of rotated vectors, batch by batch in NumPy.

Conventions: the one-bit code has a bit where a component is > 0; the full code's
top bit is set where it is >= 0.  Bits are packed least significant first.
"""

from __future__ import annotations

import numpy as np

#: The fraction of the largest rescale factor at which the sweep
#: starts, by number of extra bits.
TIGHT_START = (0.0, 0.15, 0.20, 0.52, 0.59, 0.71, 0.75, 0.77, 0.81)
EPSILON = 1e-5


def one_bit(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits (n, P) and factors 1 / <bits - 1/2, rotated>."""
    if not rotated.any(axis=1).all():
        raise ValueError("an all-zero vector has no code")
    bits = rotated > 0
    return bits, 1.0 / ((bits - 0.5) * rotated).sum(axis=1)


def pack_words(bits: np.ndarray) -> np.ndarray:
    """(n, P) bits as (n, P / 64) signed 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def unpack_words(words: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words, "<i8").view(np.uint8).reshape(-1, dim // 8), axis=1, bitorder="little")


def pack_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """(n, P) codes of ``width`` bits (1 to 8) as (n, P * width / 8) bytes."""
    bits = (codes[:, :, None].astype(np.uint8) >> np.arange(width, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(codes), -1), axis=1, bitorder="little")


def unpack_codes(packed: np.ndarray, dim: int, width: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), dim, width)
    return (bits.astype(np.int16) << np.arange(width, dtype=np.int16)).sum(axis=2)


#: Rows swept at a time.
SWEEP_ROWS = 64


def best_rescale(magnitude: np.ndarray, ex_bits: int) -> np.ndarray:
    """For each row of |component| / norm, the factor t whose quantised code has
    the largest cosine with the row.

    As t grows, component i moves to its next level at t = level / a_i.  All such
    moves of a row, in order of (t, dimension), are one sequence, and numerator and
    squared denominator of the cosine are running sums along it.  The sequences of
    many rows are the rows of one matrix, filled up with moves that never come.
    """
    out = np.empty(len(magnitude))
    for b in range(0, len(magnitude), SWEEP_ROWS):
        out[b : b + SWEEP_ROWS] = _swept(magnitude[b : b + SWEEP_ROWS], ex_bits)
    return out


def _swept(a: np.ndarray, ex_bits: int) -> np.ndarray:
    top = (1 << ex_bits) - 1
    rows, dims = a.shape
    end = (top + 10) / a.max(axis=1, keepdims=True)
    start = np.floor(end * TIGHT_START[ex_bits] * a + EPSILON)
    # The first move of a dimension is taken in any case, later ones up to the top level and the end.
    last = np.minimum(top, np.floor(end * a) + 1)
    count = np.maximum(last - start, 1).astype(np.int64).ravel()
    place = np.repeat(np.arange(rows * dims), count)
    step = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    level = start.ravel()[place] + 1 + step
    with np.errstate(divide="ignore"):
        t = level / a.ravel()[place]
    use = (step == 0) | (t < end.ravel()[place // dims])
    t, level, place = t[use], level[use], place[use]
    row = place // dims
    length = np.bincount(row, minlength=rows)
    column = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    moves = np.full((rows, int(length.max())), np.inf)
    moves[row, column] = t
    # Columns come by dimension, so a stable order is the order of (t, dimension); it
    # is only needed where two moves come at one time.
    order = np.argsort(moves, axis=1)
    timed = np.take_along_axis(moves, order, 1)
    ties = np.flatnonzero(((timed[:, 1:] == timed[:, :-1]) & np.isfinite(timed[:, 1:])).any(axis=1))
    order[ties] = np.argsort(moves[ties], axis=1, kind="stable")
    gain, cost = np.zeros_like(moves), np.zeros_like(moves)
    gain[row, column], cost[row, column] = a.ravel()[place], 2 * level
    num = ((start + 0.5) * a).sum(axis=1, keepdims=True) + np.cumsum(np.take_along_axis(gain, order, 1), axis=1)
    den = dims / 4 + (start * start + start).sum(axis=1, keepdims=True) + np.cumsum(np.take_along_axis(cost, order, 1), axis=1)
    cosine = num / np.sqrt(den)
    cosine[np.arange(moves.shape[1]) >= length[:, None]] = -np.inf
    best = np.take_along_axis(order, cosine.argmax(axis=1)[:, None], 1)
    return np.take_along_axis(moves, best, 1)[:, 0]


def ex_codes(rotated: np.ndarray, ex_bits: int) -> np.ndarray:
    """(n, P) codes of ``ex_bits`` bits of the magnitudes; mirrored where negative."""
    a = np.abs(rotated) / np.linalg.norm(rotated, axis=1, keepdims=True)
    top = (1 << ex_bits) - 1
    code = np.minimum(np.floor(best_rescale(a, ex_bits)[:, None] * a + EPSILON), top).astype(np.int64)
    return np.where(rotated < 0, top - code, code)


def full_codes(rotated: np.ndarray, ex_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 1 + ex_bits bits and factors 1 / <code - (2**b - 1/2), rotated>."""
    code = ex_codes(rotated, ex_bits) + ((rotated >= 0).astype(np.int64) << ex_bits)
    return code, 1.0 / ((code - ((1 << ex_bits) - 0.5)) * rotated).sum(axis=1)


def query_sums(rotated: np.ndarray, ex_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What centring subtracts from a query's product with one-bit and full codes."""
    total = rotated.sum(axis=1)
    return total * 0.5, total * ((1 << (ex_bits + 1)) - 1) / 2.0


def lookup_table(rotated: np.ndarray) -> np.ndarray:
    """(n, P / 4, 16): sums of each subset of four neighbouring components."""
    subset = (np.arange(16)[:, None] >> np.arange(4)) & 1
    return rotated.reshape(len(rotated), -1, 4) @ subset.T
