"""Operator 2: removal of repeated word windows through an FM-index per shard.

A window (20 consecutive words) is a repeat if its word sequence also starts
earlier.  Words covered by repeats are removed; windows are judged on the input.

1. Every window picks an anchor, the least hash among the 8-word sequences inside
   it, so equal windows have equal anchors.  Only anchors that occur twice can
   stand in repeats.
2. The stretch of windows around one anchor is a segment.  Segments with a
   repeated anchor go to that anchor's shard.  Of equal segments of one task, only
   the earliest has to; the others are repeats already and are spread evenly.  An
   anchor that is very frequent would still gather many different segments, so
   its segments are cut into single windows, dealt by their own hash.
3. A shard indexes its distinct segments (suffix array, BWT, wavelet matrix) and
   streams them through backward search.  Where the matching statistic reaches the
   window and its interval holds more than one suffix, all places of the window are
   one run of the suffix array, and the earliest of them is the original.  A segment
   that equals an earlier one is a repeat as a whole, by its hash.
4. The removed spans go back to their documents.

Word identity is a 64-bit hash.  Defined results: null text has no words; rows
with one doc_id count as one document, and a window at one place of several such
rows as one occurrence; a null doc_id comes before all others; other columns are
carried by ``deduplicated`` and ignored by ``removed_words``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .fm_index import FMIndex
from .jaccard_join import digest_filter, passes
from .store import discard, saved
from .textops import chunks, full_windows, mix64, signed, span_sequence_hashes, window_hashes, words

ANCHOR = 8
#: Symbols indexed together; a shard is cut at the next anchor beyond.
SHARD_SYMBOLS = 1_500_000
_LOWEST = -(1 << 63)
#: Segments that a task remembers, about 300 bytes each.  What it has forgotten goes to
#: the shard once more and is found equal there.
REMEMBERED = 500_000


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document: anchor places, and the first and last window of each stretch."""
    n = len(hashes) - window + 1
    grams = window_hashes(hashes, ANCHOR)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - ANCHOR + 1).argmin(axis=1) + np.arange(n)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[cut], cut, np.concatenate([cut[1:], [n]]) - 1


def _document_anchors(w, window: int) -> tuple[np.ndarray, ...]:
    """As ``anchors`` for all rows of a chunk: (row, anchor hash, place, first, last)
    with places and windows relative to the row."""
    at, row = full_windows(w.first, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, none
    grams = window_hashes(w.hash, ANCHOR)
    span = window - ANCHOR + 1
    best = np.empty(len(at), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    for b in range(0, len(at), 65536):
        some = at[b : b + 65536]
        best[b : b + 65536] = view[some].argmin(axis=1) + some
    cut = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([cut[1:], [len(at)]]) - 1
    base = w.first[row[cut]]
    return row[cut], grams[best[cut]], best[cut] - base, at[cut] - base, at[last] - base


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))


def _scan_anchors(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for b, e in chunks(texts):
                row, value, place, _, _ = _document_anchors(words(texts.slice(b, e - b)), window)
                yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(keys[b + row]), pa.array(place.astype(np.int32))], names=["anchor", "doc", "place"])

    return run


_SEGMENT = "anchor long, content long, doc long, digest long, start int, size int, body binary"


def _cut(row: np.ndarray, value: np.ndarray, first: np.ndarray, last: np.ndarray, hot: np.ndarray, grams: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments (row, key, first, last) with those of hot anchors cut into windows;
    ``grams`` are the window hashes by place, ``base`` the place of each row."""
    count = np.where(hot, last - first + 1, 1)
    at = np.repeat(np.arange(len(row)), count)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    cut = hot[at]
    begin = first[at] + inside
    stop = np.where(cut, begin, last[at])
    key = np.where(cut, grams[np.where(cut, base[row[at]] + begin, 0)], value[at])
    return row[at], key, begin, stop


def _scan_segments(window: int) -> Callable:
    """Segments of documents (doc, digest, text, places), where the places of hot
    anchors are given as -1 - place.  Rows of a negative size are repeats for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in batches:
            texts = batch.column(2).fill_null("")
            keys, digests = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for b, e in chunks(texts):
                lists = batch.column(3).slice(b, e - b)
                w = words(texts.slice(b, e - b))
                row, value, place, first, last = _document_anchors(w, window)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(e - b), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                wide = np.int64(1) << np.int64(32)
                hot = np.isin(row * wide + place, owner[flat < 0] * wide - 1 - flat[flat < 0])
                keep = hot | np.isin(row * wide + place, owner * wide + flat)
                row, value, first, last, hot = row[keep], value[keep], first[keep], last[keep], hot[keep]
                if hot.any():
                    row, value, first, last = _cut(row, value, first, last, hot, window_hashes(w.hash, window), w.first)
                size = last - first + window
                begin = w.first[row] + first
                content = span_sequence_hashes(w.hash, begin, size)
                if len(least) > REMEMBERED:
                    least.clear()
                bodies: list[bytes | None] = []
                doc, sure = keys[b + row], np.zeros(len(row), bool)
                for k, (key, when) in enumerate(zip(zip(value.tolist(), content.tolist(), strict=True), zip(doc.tolist(), first.tolist(), strict=True), strict=True)):
                    seen = least.get(key)
                    if seen is None:
                        bodies.append(w.hash[begin[k] : begin[k] + size[k]].tobytes())
                    else:
                        bodies.append(None)
                        sure[k] = when > seen
                    if seen is None or when < seen:
                        least[key] = when
                # Neighbouring repeats are one row; a whole copy of a document mostly is.
                joins = np.zeros(len(row), bool)
                joins[1:] = sure[1:] & sure[:-1] & (row[1:] == row[:-1]) & (first[1:] == last[:-1] + 1)
                heads = np.flatnonzero(~joins)
                if len(heads):
                    end = last[np.concatenate([heads[1:], [len(row)]]) - 1]
                    row, first, value, content, doc, sure = (x[heads] for x in (row, first, value, content, doc, sure))
                    size, bodies = end - first + window, [bodies[k] for k in heads.tolist()]
                size = np.where(sure, -size, size)
                value = np.where(sure, mix64(doc.astype(np.uint64) * np.uint64(31) + first.astype(np.uint64)), value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(value)), pa.array(signed(content)), pa.array(keys[b + row]), pa.array(digests[b + row]), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(bodies, pa.binary())],
                    names=["anchor", "content", "doc", "digest", "start", "size", "body"],
                )

    return run


def _repeats(index: FMIndex, doc: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Text positions of the windows of an index that also start earlier."""
    at, run = index.windows_of_parts()
    size = len(index.text)
    part = np.full(size, -1)
    part[index.place] = np.repeat(np.arange(len(doc)), index.end - index.begin)
    inside = np.flatnonzero(part >= 0)
    d, s = doc[part[inside]], start[part[inside]] + inside - index.begin[part[inside]]
    order = np.lexsort((s, d))
    fresh = np.zeros(len(order), np.int64)
    fresh[1:] = (d[order][1:] != d[order][:-1]) | (s[order][1:] != s[order][:-1])
    when = np.full(size, size, np.int64)
    when[inside[order]] = np.cumsum(fresh)
    return at[index.least(when)[run] < when[at]]


class _Shard:
    """Distinct segments to be indexed together, and the texts they stand in first."""

    def __init__(self, window: int):
        self.window = window
        self.bodies: list[bytes] = []
        self.rows: list[np.ndarray] = []  # doc, digest, start
        self.more: list[tuple[int, int]] = []  # (segment, digest): other texts under one doc_id
        self.symbols = 0

    def add(self, bodies: list[bytes], rows: np.ndarray) -> None:
        self.bodies += bodies
        self.rows.append(rows)
        self.symbols += sum(map(len, bodies)) // 8

    def spans(self) -> np.ndarray:
        """doc, digest, first, last of the repeated words of the segments."""
        if not self.bodies:
            return np.zeros((0, 4), np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in self.bodies])])
        index = FMIndex(np.frombuffer(b"".join(self.bodies), np.uint64), bounds, self.window)
        rows = np.concatenate(self.rows)
        found = np.sort(_repeats(index, rows[:, 0], rows[:, 2], self.window))
        if not len(found):
            return np.zeros((0, 4), np.int64)
        cut = np.concatenate([[True], found[1:] > found[:-1] + 1])
        first, last = found[cut], found[np.concatenate([cut[1:], [True]])]
        part = np.searchsorted(index.begin, first, side="right") - 1
        shift = rows[part, 2] - index.begin[part]
        out = np.stack([rows[part, 0], rows[part, 1], first + shift, last + shift + self.window], axis=1)
        if self.more:  # ``part`` is in order
            segment, digest = np.array(self.more, np.int64).T
            low, high = np.searchsorted(part, segment, side="left"), np.searchsorted(part, segment, side="right")
            n = high - low
            extra = out[np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)]
            extra[:, 1] = np.repeat(digest, n)
            out = np.concatenate([out, extra])
        return out

    def next(self) -> _Shard:
        """The shard after this one, with the other texts of segments yet to come."""
        out, closed = _Shard(self.window), len(self.bodies)
        out.more = [(k - closed, digest) for k, digest in self.more if k >= closed]
        self.more = [(k, digest) for k, digest in self.more if k < closed]
        return out


def _spans_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32))], names=["doc", "digest", "first", "last"])


def _search_shards(window: int) -> Callable:
    """Rows come sorted by anchor, content, doc and start.  The first row of a run
    of one content is its original; the others repeat it as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(window)
        head: np.ndarray | None = None  # the open run's original: anchor, content, doc, digest, start
        body: bytes | None = None

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], axis=1)
            sure = rows[:, 5] < 0
            if sure.any():
                yield _spans_batch(np.stack([rows[sure, 2], rows[sure, 3], rows[sure, 4], rows[sure, 4] - rows[sure, 5]], axis=1))
                rows, batch = rows[~sure], batch.filter(pa.array(~sure))
                if not len(rows):
                    continue
            valid = np.flatnonzero(batch.column(6).is_valid().to_numpy(zero_copy_only=False))
            same = np.zeros(len(rows), bool)
            same[1:] = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
            same[0] = head is not None and bool((rows[0, :2] == head[:2]).all())
            start = np.flatnonzero(~same)
            run_of = np.cumsum(~same) - 1  # -1: the run left open by the batch before
            originals = rows[start][:, [0, 1, 2, 3, 4]]
            if head is not None:
                originals, run_of = np.concatenate([head[None], originals]), run_of + 1
            # Bodies: the first one carried by any row of a run.
            bodies: list[bytes | None] = [None] * len(originals)
            if head is not None:
                bodies[0] = body
            owners = run_of[valid]
            fresh = np.concatenate([[True], owners[1:] != owners[:-1]]) if len(owners) else np.zeros(0, bool)
            for k, value in zip(owners[fresh].tolist(), batch.column(6).take(pa.array(valid[fresh])).to_pylist(), strict=True):
                bodies[k] = bodies[k] or value
            own = originals[run_of]
            later = same & ((rows[:, 2] != own[:, 2]) | (rows[:, 4] != own[:, 4]))
            twin = same & ~later & (rows[:, 3] != own[:, 3])
            if later.any():
                yield _spans_batch(np.stack([rows[later, 2], rows[later, 3], rows[later, 4], rows[later, 4] + rows[later, 5]], axis=1))
            # All runs but the last are complete; a shard may be cut where the anchor changes.
            done = len(originals) - 1
            begin = 0
            base = len(shard.bodies)
            for k in np.flatnonzero(twin).tolist():
                shard.more.append((base + int(run_of[k]), int(rows[k, 3])))
            cuts = np.flatnonzero(originals[1:, 0] != originals[:-1, 0]) + 1
            for cut in [*cuts[cuts <= done].tolist(), done]:
                if cut == done or shard.symbols + 8 * (cut - begin) >= SHARD_SYMBOLS:
                    shard.add(bodies[begin:cut], originals[begin:cut][:, [2, 3, 4]])
                    begin = cut
                if shard.symbols >= SHARD_SYMBOLS and originals[cut, 0] != originals[cut - 1, 0]:
                    after = shard.next()
                    yield _spans_batch(shard.spans())
                    shard = after
            head, body = originals[-1], bodies[-1]
        if head is not None:
            shard.add([body], head[None, [2, 3, 4]])
        yield _spans_batch(shard.spans())

    return run


def _sift(shared) -> Callable:
    """Rows (doc, key, digest, text) that the filter lets pass, without the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(passes(shared.value, batch.column(1)))).select([0, 2, 3])

    return run


#: An anchor with more places is hot.
HOT = 50_000


def repeated_spans(docs: DataFrame, window: int = 20, hot: int = HOT) -> DataFrame:
    """doc, digest, spans: word spans (first, last) to remove of each document text."""
    keyed = docs.select(_key().alias("doc"), F.xxhash64("text").alias("digest"), "text")
    places = saved(keyed.select("doc", "text").mapInArrow(_scan_anchors(window), "anchor long, doc long, place int"), "anchors")
    # Written apart, so that the join below reads two plain exchanges and a hot anchor can be split.
    often = saved(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("hot")), "repeated")
    hits = places.join(often, "anchor").select("doc", F.when(F.col("hot"), -1 - F.col("place")).otherwise(F.col("place")).alias("place"))
    hits = saved(hits.groupBy("doc").agg(F.collect_list("place").alias("places")), "anchor-places")
    discard(places)
    discard(often)
    # A filter of fixed size keeps most texts without repeated anchors out of the exchange.
    shared = docs.sparkSession.sparkContext.broadcast(digest_filter(hits.select(F.xxhash64("doc").alias("digest"))))
    wanted = keyed.select("doc", F.xxhash64("doc").alias("key"), "digest", "text").mapInArrow(_sift(shared), "doc long, digest long, text string")
    met = wanted.join(hits, "doc").select("doc", "digest", "text", "places")
    segments = met.mapInArrow(_scan_segments(window), _SEGMENT)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "doc", "start")
    spans = dealt.mapInArrow(_search_shards(window), "doc long, digest long, first int, last int")
    return spans.groupBy("doc", "digest").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _kept(w, row: int, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    begin, stop = int(w.first[row]), int(w.first[row + 1])
    keep = np.ones(stop - begin, bool)
    for x in spans or ():
        keep[x["first"] : x["last"]] = False
    at = np.flatnonzero(keep) + begin
    data = w.data
    return stop - begin, [data[a:b].tobytes() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]


def _joined(docs: DataFrame, window: int) -> DataFrame:
    spans = saved(repeated_spans(docs, window), "spans")
    keyed = docs.withColumns({"_doc": _key(), "_digest": F.xxhash64("text")})
    right = spans.select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    return keyed.join(right, ["_doc", "_digest"], "left")


def removed_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for b, e in chunks(texts):
                w = words(texts.slice(b, e - b), hashes=False)
                lists = batch.column(2).slice(b, e - b).to_pylist()
                total, removed, digest = [], [], []
                for k, spans in enumerate(lists):
                    n, kept = _kept(w, k, spans)
                    total.append(n)
                    removed.append(n - len(kept))
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b, e - b), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _joined(docs.select("doc_id", "text"), window).select("doc_id", "text", "_spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` with texts reduced to their kept words, joined by one space, where
    something was removed; documents of which nothing is left are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = [k for k, x in enumerate(lists) if x]
            w = words(pa.array([out[k] for k in hit], pa.string()), hashes=False)
            for j, k in enumerate(hit):
                out[k] = b" ".join(_kept(w, j, lists[k])[1]).decode()
            stays = pa.array([x is None or t != "" for x, t in zip(lists, out, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_row", "_text"]).filter(stays)

    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    joined = _joined(rows, window).select("_row", "text", "_spans")
    schema = T.StructType([joined.schema["_row"], T.StructField("_text", T.StringType())])
    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))
