"""A compressed full-text index over integer symbols: BWT, wavelet matrix, backward search.

All searches are vectorised over many patterns at once: one backward step of all
patterns is a pair of gathers per wavelet level.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_LOW6 = np.uint64(63)


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the ranks of the prefixes of length
    ``2**floor(log2(depth))``, by position.

    The text must end each part in a symbol of its own, so that doubling stops
    after about log2(longest part) rounds.
    """
    n = len(text)
    kept = 1 << (depth.bit_length() - 1)
    order = np.argsort(text, kind="stable")
    rank = _ranks(text[order], order)
    at_depth, k = rank, 1
    while True:
        if k == kept:
            at_depth = rank
        if int(rank[order[-1]]) == n - 1:
            break
        key = rank * np.int64(n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        rank = _ranks(key[order], order)
        k *= 2
        if k >= 2 * n:
            break
    if k < kept:  # all suffixes differ sooner, so longer prefixes rank alike
        at_depth = rank
    return order, at_depth


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    step = np.zeros(len(ordered), np.int64)
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(ordered), np.int64)
    rank[order] = np.cumsum(step)
    return rank


class BitRank:
    """A bit vector in 64-bit words with a count before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        got = np.packbits(bits, bitorder="little")
        packed[: len(got)] = got
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        mask = (_ONE << (i.astype(np.uint64) & _LOW6)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[BitRank] = []
        self.zeros: list[int] = []
        row = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.bits.append(BitRank(bit.astype(np.uint8)))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.start = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(range(self.levels - 1, -1, -1), self.bits, self.zeros, strict=True):
            ones = bits.ones(i).astype(np.int64)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbol, i) - self.start[symbol]


class FMIndex:
    """Index of parts (symbol sequences, given end to end with their bounds).

    ``part`` symbols are any 64-bit values; they are numbered densely inside.
    Each part ends in a separator of its own.
    """

    def __init__(self, values: np.ndarray, bounds: np.ndarray, window: int):
        parts = len(bounds) - 1
        self.window = window
        self.alphabet, dense = np.unique(values, return_inverse=True)
        self.offset = parts
        size = parts + len(self.alphabet)
        length = np.diff(bounds)
        self.begin = bounds[:-1] + np.arange(parts)
        self.end = self.begin + length
        text = np.empty(len(values) + parts, np.int64)
        place = np.arange(len(values)) + np.repeat(np.arange(parts), length)
        text[place] = dense + parts
        text[self.end] = np.arange(parts)
        self.text, self.place = text, place
        self.order, ranks = suffix_array(text, window)
        self.wavelet = WaveletMatrix(text[self.order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        # Runs of suffixes that agree on `window` symbols: compare two overlapping prefixes.
        p = 1 << (window.bit_length() - 1)
        tail = np.minimum(np.arange(len(text)) + window - p, len(text) - 1)
        a, b = ranks[self.order], ranks[tail[self.order]]
        fresh = np.ones(len(text), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.run = np.cumsum(fresh) - 1
        self.run_start = np.flatnonzero(fresh)
        self.run_size = np.diff(np.append(self.run_start, len(text)))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Extend each pattern's suffix interval by one symbol to the left."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def windows_of_parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Stream every part through the index from its right end.

        Returns text positions whose matching statistic reaches the window and whose
        window's interval has two suffixes or more, so that it occurs elsewhere too,
        and for each the number of its run of equal windows.
        """
        length = self.end - self.begin
        order = np.argsort(-length, kind="stable")
        end, length = self.end[order], length[order]
        low, high = np.zeros(len(end), np.int64), np.full(len(end), len(self.text), np.int64)
        positions, runs = [], []
        for t in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -t, side="left"))
            at = end[:active] - 1 - t
            low, high = self.step(self.text[at], low[:active], high[:active])
            if t + 1 >= self.window:
                # The part from here on is one suffix of the run, the interval of its first ``window`` symbols.
                run = self.run[low]
                many = self.run_size[run] > 1
                positions.append(at[many])
                runs.append(run[many])
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(positions), np.concatenate(runs)

    def count(self, patterns: np.ndarray) -> np.ndarray:
        """Occurrences of each row of ``patterns`` (values, one pattern a row)."""
        k = np.minimum(np.searchsorted(self.alphabet, patterns), len(self.alphabet) - 1)
        known = (self.alphabet[k] == patterns).all(axis=1)
        codes = k + self.offset
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.text), np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            low, high = self.step(codes[:, j], low, high)
            high = np.maximum(high, low)
        return np.where(known, high - low, 0)

    def least(self, key: np.ndarray) -> np.ndarray:
        """Least key of each run; ``key`` is by text position."""
        return np.minimum.reduceat(key[self.order], self.run_start)
