"""A seeded norm-preserving rotation: rounds of random signs and a Hadamard transform."""

from __future__ import annotations

from functools import cache

import numpy as np

ROUNDS = 3
_MASK = (1 << 32) - 1


def signs(dim: int, turn: int, seed: int) -> np.ndarray:
    """+1 or -1 for each dimension, from 32-bit integer arithmetic alone."""
    i = np.arange(1, dim + 1, dtype=np.uint64)
    mask = np.uint64(_MASK)
    z = (i * np.uint64(2654435761) + np.uint64((turn + 1) * 40503 * 65537 + seed * 97)) & mask
    z = ((z ^ (z >> np.uint64(15))) * np.uint64(739982445)) & mask
    z ^= z >> np.uint64(12)
    return 1.0 - 2.0 * ((z >> np.uint64(9)) % np.uint64(2)).astype(float)


def hadamard(dim: int) -> np.ndarray:
    i = np.arange(dim)
    return 1.0 - 2.0 * (np.bitwise_count(i[:, None] & i[None, :]) % 2)


@cache
def matrix(dim: int, seed: int) -> np.ndarray:
    """The rotation as a dim x dim matrix; rows of vectors are rotated by ``x @ matrix.T``."""
    out = np.eye(dim)
    h = hadamard(dim) / np.sqrt(dim)
    for turn in range(ROUNDS):
        out = h @ (signs(dim, turn, seed)[:, None] * out)
    return out


def rotate(x: np.ndarray, padded: int, seed: int) -> np.ndarray:
    """Rotate rows, padding them with zeros to ``padded`` dimensions."""
    return x @ matrix(padded, seed)[:, : x.shape[1]].T
