"""Operator 5: benchmark decontamination with SimHash windows.

For every benchmark item the documents are seen through windows of the item's
own length in words.  Every window gets a 64-bit SimHash, weighted by how often each
shingle occurs in it: running sums of the shingles' bits give the fingerprints of
all windows of a length by one subtraction.  A multi-index over four 16-bit blocks
finds every item whose fingerprint is within the radius: a pair within radius r has
a block within r // 4, and a block's index lists all values that near to an item's.
Candidates are verified exactly by weighted shingle similarity, sum(min) / sum(max)
of the occurrence counts.

At similarity 0.8 fingerprints differ in 9.7 bits on average, with a standard
deviation of 2.9; the default radius is 15, and a pair nearer to 1 is far inside.  A
random pair passes the block index at 4 % and the radius at a few in 100,000.

The benchmark is read in blocks of at most ``block_bytes`` of text and 128 lengths,
by ranges of length, so that no length is fingerprinted twice; only such a block is
broadcast.  Documents are scanned once for each block.  Long texts are met in slices,
so memory does not grow with them.  Words are maximal runs of non-space bytes, A-Z
lower-cased.

Defined results: an item of fewer than ``shingle`` words is one shingle, its
whole sequence; a document shorter than an item is one window, its whole text;
null and empty texts and items match nothing; repeated rows of either table give
repeated pairs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .textops import Words, chunks, span_sequence_hashes, window_hashes, words

BLOCKS, BLOCK_BITS = 4, 16
#: Windows met at a time, and those fingerprinted at a time.
SLICE, TILE = 16384, 4096
#: Lengths of items in one broadcast block; each has a table of 64 KB and lists.
MOST_LENGTHS = 128
RADIUS = 15
#: A length with more items is looked up by the values of its blocks.
FEW = 16
#: The flag of each block in its own byte.
_OWN_FLAGS = np.array([1 << b for b in range(BLOCKS)], np.uint8).view(np.uint32)[0]


def running_bits(shingles: np.ndarray, most: int) -> np.ndarray:
    """Counts of each bit before each place.  They wrap around, which differences
    over up to ``most`` places do not mind."""
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    out = np.zeros((len(shingles) + 1, 64), kind)
    out[1:] = np.unpackbits(shingles.view(np.uint8)).reshape(-1, 64)
    other, k = np.empty_like(out), 1
    while k < len(out):  # sums over twice as many places each time
        other[:k] = out[:k]
        np.add(out[k:], out[:-k], out=other[k:])
        out, other, k = other, out, 2 * k
    return out


class _Printer:
    """Fingerprints of many windows, in tiles that stay in a core's cache."""

    def __init__(self):
        self.ones, self.set = np.empty((TILE, 64), np.uint8), np.empty((TILE, 64), bool)

    def windows(self, bits: np.ndarray, count: int, n: int) -> np.ndarray:
        """Of ``count`` shingles from each of the first n places."""
        if self.ones.dtype != bits.dtype:
            self.ones = np.empty((TILE, 64), bits.dtype)
        out = np.empty((n, 8), np.uint8)
        for b in range(0, n, TILE):
            m = min(TILE, n - b)
            np.subtract(bits[b + count : b + count + m], bits[b : b + m], out=self.ones[:m])
            np.greater(self.ones[:m], count // 2, out=self.set[:m])
            out[b : b + m] = np.packbits(self.set[:m]).reshape(-1, 8)
        return out.view(np.uint64).ravel()


def fingerprint(shingles: np.ndarray) -> np.uint64:
    """SimHash: the bits that most shingles have, repeated ones counted as often."""
    ones = np.unpackbits(shingles.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(ones > len(shingles) // 2).view(np.uint64)[0]


def similarity(window: np.ndarray, item: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of a window's shingle hashes and an item's distinct ones with counts."""
    x, m = np.unique(window, return_counts=True)
    y, n = item
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = int(np.minimum(m[at], n)[x[at] == y].sum())
    return common / (len(window) + int(n.sum()) - common)


def _near(errors: int) -> np.ndarray:
    """Block values with at most so many bits set."""
    value = np.arange(1 << BLOCK_BITS, dtype=np.uint16)
    return value[np.bitwise_count(value) <= errors]


class _Class:
    """Items of one length: their shingles, fingerprints and block index."""

    def __init__(self, n_words: int, size: int, radius: int):
        self.n_words, self.size, self.radius = n_words, size, radius
        self.count = n_words - size + 1
        self.ids: list[int] = []
        self.shingles: list[np.ndarray] = []

    def seal(self) -> None:
        """A flag, by block, for every value that an item is near to, and for each such
        value, in order, the items."""
        self.bags = [np.unique(s, return_counts=True) for s in self.shingles]
        self.prints = np.array([fingerprint(s) for s in self.shingles], np.uint64)
        near = _near(self.radius // BLOCKS)
        item = np.repeat(np.arange(len(self.prints)), len(near))
        self.flags, self.values, self.items = np.zeros(1 << BLOCK_BITS, np.uint8), [], []
        for b, own in enumerate(self.prints.view(np.uint16).reshape(-1, BLOCKS).T):
            value = (own[:, None] ^ near[None]).ravel()
            order = np.argsort(value, kind="stable")
            self.flags[value] |= np.uint8(1 << b)
            self.values.append(value[order])
            self.items.append(item[order])

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius, of windows that
        pass the flags.  Few items are each compared, which is less work than a look
        at the lists of the blocks."""
        if len(self.prints) <= FEW:
            distance = np.bitwise_count(prints[:, None] ^ self.prints)
            at = np.flatnonzero((distance <= self.radius).ravel())
            window, item = np.divmod(at, len(self.prints))
            return window, item, distance.ravel()[at].astype(np.int64)
        part = prints.view(np.uint16).reshape(-1, BLOCKS)
        found = []
        for b in range(BLOCKS):
            some = np.flatnonzero(self.flags[part[:, b]] & (1 << b))
            if not len(some):
                continue
            low = np.searchsorted(self.values[b], part[some, b], side="left")
            n = np.searchsorted(self.values[b], part[some, b], side="right") - low
            at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
            window, item = np.repeat(some, n), self.items[b][at]
            distance = np.bitwise_count(prints[window] ^ self.prints[item]).astype(np.int64)
            keep = distance <= self.radius
            found.append(np.stack([window[keep], item[keep], distance[keep]]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


class BenchmarkIndex:
    """A block of items, ready to be met by documents."""

    def __init__(self, ids: list, texts: pa.Array, shingle: int, threshold: float, radius: int):
        self.shingle, self.threshold = shingle, threshold
        self.ids, self.printer = ids, _Printer()
        w = words(texts, lower=True)
        classes: dict[int, _Class] = {}
        for k in range(len(w.first) - 1):
            h = w.hash[w.first[k] : w.first[k + 1]]
            if len(h):
                size = min(shingle, len(h))
                c = classes.setdefault(len(h), _Class(len(h), size, radius))
                c.ids.append(k)
                c.shingles.append(window_hashes(h, size).copy())
        for c in classes.values():
            c.seal()
        #: Lengths met together: one shingle size, counts that fit the same running sums.
        self.groups: dict[tuple[int, int], list[_Class]] = {}
        for n in sorted(classes):
            c = classes[n]
            self.groups.setdefault((c.size, (c.count >= 1 << 8) + (c.count >= 1 << 16)), []).append(c)

    def search(self, w: Words) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item, start, n_words, distance, similarity): the best window of each pair."""
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for (size, _), classes in self.groups.items():
            value = window_hashes(w.hash, size)
            if len(value):
                self._short(classes, size, w, value, best)
                most = classes[-1].count
                step = max(SLICE, 2 * most)
                for b in range(0, len(value), step):
                    self._slice(classes, w, value, b, min(b + step, len(value)), most, best)
        for (row, item), (got, minus, length, distance) in sorted(best.items()):
            yield row, item, -minus, length, distance, got

    def _slice(self, classes: list[_Class], w: Words, value: np.ndarray, b: int, e: int, most: int, best: dict) -> None:
        """Windows that start at words b to e."""
        bits = running_bits(value[b : e + most - 1], most)
        start = np.arange(b, e)
        row = np.searchsorted(w.first, start, side="right") - 1
        room = w.first[row + 1] - start
        for c in classes:
            n = min(e - b, len(bits) - c.count)
            if n <= 0:
                continue
            prints = self.printer.windows(bits, c.count, n)
            near = c.flags.take(prints.view(np.uint16)).view(np.uint32) & _OWN_FLAGS
            at = np.flatnonzero(near != 0)
            at = at[room[at] >= c.n_words]
            if len(at):
                window, item, distance = c.candidates(prints[at])
                if len(window):
                    own = at[window]
                    self._verify(c, w, value, row[own], start[own], np.full(len(own), c.n_words), item, distance, best)

    def _short(self, classes: list[_Class], size: int, w: Words, value: np.ndarray, best: dict) -> None:
        """Texts shorter than an item, as one window each."""
        length = np.diff(w.first)
        some = np.flatnonzero((length >= size) & (length < classes[-1].n_words))
        if not len(some):
            return
        prints = np.array([fingerprint(value[w.first[r] : w.first[r] + length[r] - size + 1]) for r in some.tolist()], np.uint64)
        for c in classes:
            own = np.flatnonzero(length[some] < c.n_words)
            window, item, distance = c.candidates(prints[own])
            if len(window):
                rows = some[own[window]]
                self._verify(c, w, value, rows, w.first[rows], length[rows], item, distance, best)

    def _verify(self, c: _Class, w: Words, value: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, item: np.ndarray, distance: np.ndarray, best: dict) -> None:
        """Keep the best window of each pair at or over the threshold.  Equal windows are
        compared once, and none whose shingles in common, repeated ones included,
        cannot beat the best so far."""
        low, high = int(start.min()), int((start + length).max())
        content = span_sequence_hashes(w.hash[low:high], start - low, length)
        count = length - c.size + 1
        flat = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        bound = np.zeros(len(item))
        for i in np.unique(item).tolist():
            own = item == i
            x, y = value[flat[np.repeat(own, count)]], c.bags[i][0]
            hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
            most = np.minimum(np.add.reduceat(hit, np.cumsum(count[own]) - count[own], dtype=np.int64), c.count)
            bound[own] = most / (count[own] + c.count - most)
        known: dict[tuple[int, int], float] = {}
        order = np.lexsort((start, -bound))
        order = order[bound[order] >= self.threshold]
        for r, s, n, i, d, key, most in zip(*(x[order].tolist() for x in (row, start, length, item, distance, content, bound)), strict=True):
            pair = r, c.ids[i]
            at = int(w.first[r]) - s
            if pair in best and (most, at) <= best[pair][:2]:
                continue
            got = known.get((key, i))
            if got is None:
                got = known[key, i] = similarity(value[s : s + n - c.size + 1], c.bags[i])
            if got >= self.threshold and (pair not in best or (got, at) > best[pair][:2]):
                best[pair] = got, at, n, d


SCHEMA = "start long, n_words long, distance long, similarity double"


def _word_count(text: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))


def item_blocks(sizes: list[tuple[int, int]], block_bytes: int) -> list[tuple[int, int, int]]:
    """(least length, greatest length, number of parts) of blocks for lengths with
    their bytes, in order; a length of more bytes than a block is cut into parts."""
    out: list[list[int]] = []
    used = lengths = 0
    for n, size in sizes:
        if out and out[-1][2] == 1 and used + size <= block_bytes and lengths < MOST_LENGTHS:
            out[-1][1], used, lengths = n, used + size, lengths + 1
        else:
            out.append([n, n, max(1, -(-size // block_bytes))])
            used, lengths = size, 1
    return [tuple(x) for x in out]


def _indexes(benchmark: DataFrame, block_bytes: int) -> Iterator:
    """Broadcast (item ids, texts) of bounded blocks of the benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text", _word_count("text").alias("_words")).where("_words > 0")
    sizes = items.groupBy("_words").agg(F.sum(F.octet_length("text")).alias("size")).orderBy("_words").collect()  # a row for each length
    for low, high, parts in item_blocks([(r["_words"], r["size"]) for r in sizes], block_bytes) or [(0, 0, 1)]:
        for k in range(parts):
            rows = items.where(F.col("_words").between(low, high) & (F.pmod(F.xxhash64("text"), F.lit(parts)) == k)).orderBy("item_id", "text").collect()  # about ``block_bytes``
            yield spark.sparkContext.broadcast((pa.array([r["item_id"] for r in rows]), pa.array([r["text"] for r in rows], pa.string())))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, radius: int = RADIUS, block_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, start, n_words, distance, similarity: for each document
    and item with a window at or above the threshold, the best such window."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for shared in _indexes(benchmark, block_bytes):
        found = docs.select("doc_id", "text").mapInArrow(_matcher(shared, shingle, threshold, radius), f"doc_id {kinds[0]}, item_id {kinds[1]}, {SCHEMA}")
        out = found if out is None else out.unionByName(found)
    return out


def _search(shared, shingle: int, threshold: float, radius: int) -> Callable:
    ids, texts = shared.value
    index = BenchmarkIndex(ids.to_pylist(), texts, shingle, threshold, radius)

    def found(column: pa.Array) -> list[tuple[int, int, int, int, int, float]]:
        out = []
        for b, e in chunks(column):
            out += [(b + row, *rest) for row, *rest in index.search(words(column.slice(b, e - b), lower=True))]
        return out

    return found


def _matcher(shared, shingle: int, threshold: float, radius: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, ids = _search(shared, shingle, threshold, radius), shared.value[0]
        for batch in batches:
            found = search(batch.column(1).fill_null(""))
            if not found:
                continue
            row, item, *rest = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), ids.take(pa.array(item)), *(pa.array(x, pa.int64()) for x in rest[:3]), pa.array(rest[3], pa.float64())],
                names=["doc_id", "item_id", "start", "n_words", "distance", "similarity"],
            )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, radius: int = RADIUS, block_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` without the contaminated documents, in one pass without a shuffle."""
    names, schema = docs.columns, docs.schema

    def sieve(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _search(shared, shingle, threshold, radius)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in search(batch.column(names.index("text")).fill_null(""))]] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _indexes(benchmark, block_bytes):
        docs = docs.mapInArrow(sieve(shared), schema)
    return docs
