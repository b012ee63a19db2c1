"""Latent classes of texts: a mixture of word distributions over hashed words.

Fitted to all texts by expectation-maximisation, each round a pass over them; a
bounded sample gives only the points from which the rounds start.  No label is read.
The number of classes doubles as long as the fifth of all texts that is kept aside
gains by it; then all texts count.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words fall into so many buckets.
BUCKETS = 4096
#: A doubling must gain so much of log likelihood a word.
GAIN = 0.02
ROUNDS, STARTS = 15, 4
#: Rounds end when none gains so much of log likelihood a word.
SETTLED = 0.001
#: One text in so many is kept aside.
ASIDE = 5


def buckets(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.int64, n) % BUCKETS


@dataclass(frozen=True)
class Mixture:
    logp: np.ndarray  # class, bucket
    prior: np.ndarray  # logarithms, by class

    @property
    def classes(self) -> int:
        return len(self.prior)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Joint log probability of each text (a row of counts) and class."""
        return x @ self.logp.T + self.prior

    def totals(self, bucket: np.ndarray, length: np.ndarray) -> np.ndarray:
        """As ``scores``, given the buckets of the texts' words end to end."""
        out = np.tile(self.prior, (len(length), 1))
        some = np.flatnonzero(length)
        if len(some):
            at = (np.cumsum(length) - length)[some]
            for k, row in enumerate(self.logp):
                out[some, k] += np.add.reduceat(row[bucket], at)
        return out

    def best(self, bucket: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Class of each text, given the buckets of its words end to end."""
        return self.totals(bucket, length).argmax(axis=1)


@dataclass
class Sums:
    """What a round needs of the texts, under one mixture; sums of parts add up."""

    count: np.ndarray  # expected words by class and bucket
    size: np.ndarray  # expected texts by class
    told: np.ndarray  # log likelihood and words of texts that count, then of those aside

    @staticmethod
    def none(classes: int) -> Sums:
        return Sums(np.zeros((classes, BUCKETS)), np.zeros(classes), np.zeros(4))

    def add(self, mixture: Mixture, bucket: np.ndarray, length: np.ndarray, aside: np.ndarray) -> None:
        scores = mixture.totals(bucket, length)
        value = _likelihood(scores)
        share = np.where(aside[:, None], 0.0, np.exp(scores - value[:, None]))
        for k in range(mixture.classes):
            self.count[k] += np.bincount(bucket, np.repeat(share[:, k], length), minlength=BUCKETS)
        self.size += share.sum(axis=0)
        self.told += [value[~aside].sum(), length[~aside].sum(), value[aside].sum(), length[aside].sum()]

    def rows(self) -> list[np.ndarray]:
        return [*self.count, np.concatenate([self.size, self.told])]

    @staticmethod
    def of(rows: list[np.ndarray]) -> Sums:
        return Sums(np.stack(rows[:-1]), rows[-1][:-4], rows[-1][-4:])

    def mixture(self) -> Mixture:
        return _smoothed(self.count, self.size)

    def gain(self, aside: bool = False) -> float:
        """Log likelihood a word."""
        value, words = self.told[2:] if aside else self.told[:2]
        return value / max(words, 1.0)


def _smoothed(count: np.ndarray, size: np.ndarray) -> Mixture:
    count, size = count + 0.1, size + 1.0
    return Mixture(np.log(count / count.sum(axis=1, keepdims=True)), np.log(size / size.sum()))


def _estimate(x: np.ndarray, weight: np.ndarray) -> Mixture:
    return _smoothed(weight.T @ x, weight.sum(axis=0))


def _likelihood(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=1)
    return top + np.log(np.exp(scores - top[:, None]).sum(axis=1))


def _fit(x: np.ndarray, classes: int) -> Mixture:
    unit = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1.0))
    best, found = -np.inf, None
    for start in range(STARTS if classes > 1 else 1):
        r = np.random.default_rng(start)
        # Seeds: texts far from the seeds before them, at random.
        near, seeds = np.ones(len(x)), []
        for _ in range(classes):
            seeds.append(int(r.choice(len(x), p=near / near.sum())) if near.sum() > 0 else 0)
            near = np.minimum(near, np.maximum(1.0 - unit @ unit[seeds[-1]], 0.0))
        kind = (unit @ unit[seeds].T).argmax(axis=1)
        mixture = _estimate(x, np.eye(classes)[kind])
        for _ in range(ROUNDS if classes > 1 else 0):
            scores = mixture.scores(x)
            mixture = _estimate(x, np.exp(scores - _likelihood(scores)[:, None]))
        value = _likelihood(mixture.scores(x)).sum()
        if value > best:
            best, found = value, mixture
    return found


def starts(x: np.ndarray, most: int = 8) -> list[Mixture]:
    """Mixtures of 1, 2, 4, ... classes to start from, for texts given as rows of bucket counts."""
    if len(x) < 20:
        return [_estimate(x, np.ones((len(x), 1)))]
    return [_fit(x, 1 << k) for k in range(most.bit_length())]


def _settled(mixtures: list[Mixture], sums: Callable[[list[Mixture], bool], list[Sums]], whole: bool) -> tuple[list[Mixture], list[Sums]]:
    """Rounds until none gains; the mixtures and the sums under them."""
    found = sums(mixtures, whole)
    for _ in range(ROUNDS):
        better = [f.mixture() for f in found]
        then = sums(better, whole)
        gains = [t.gain() - f.gain() for t, f in zip(then, found, strict=True)]
        mixtures, found = better, then
        if max(gains) < SETTLED:
            break
    return mixtures, found


def learned(mixtures: list[Mixture], sums: Callable[[list[Mixture], bool], list[Sums]]) -> Mixture:
    """The mixture for all texts, from starting points with doubling classes.  ``sums`` passes over the
    texts, with (``whole``) or without those kept aside."""
    chosen = 0
    if len(mixtures) > 1:
        mixtures, found = _settled(mixtures, sums, False)
        while chosen + 1 < len(mixtures) and found[chosen + 1].gain(True) >= found[chosen].gain(True) + GAIN:
            chosen += 1
    return _settled([mixtures[chosen]], sums, True)[0][0]


def fitted(x: np.ndarray, most: int = 8) -> Mixture:
    """The mixture for texts given as rows of bucket counts."""
    length = x.sum(axis=1).astype(np.int64)
    bucket = np.repeat(np.tile(np.arange(x.shape[1]), len(x)), x.ravel().astype(np.int64))

    def sums(mixtures: list[Mixture], whole: bool) -> list[Sums]:
        out = [Sums.none(m.classes) for m in mixtures]
        for s, m in zip(out, mixtures, strict=True):
            s.add(m, bucket, length, (np.arange(len(x)) % ASIDE == 0) & (not whole))
        return out

    return learned(starts(x, most), sums)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            found = (text or "").encode().lower().split()
            out.append(np.bincount(buckets(found, len(found)), minlength=BUCKETS).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["counts"])


def sampled(docs: DataFrame, total: int, key: Column, sample: int) -> np.ndarray:
    """Bucket counts of about ``sample`` texts of ``total``, whole, chosen by a hash of ``key``."""
    some = docs.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1)))) if total > sample else docs
    rows = some.select("text").mapInArrow(_histograms, "counts binary").collect()  # about ``sample`` rows
    return np.array(sorted(r["counts"] for r in rows)).view("<u4").reshape(len(rows), -1).astype(float) if rows else np.zeros((0, BUCKETS))
