"""Operator 8: exact n-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 3-word shingles; two link at a Jaccard
similarity of 0.9 or more.  Only connectivity is asked for, which lets answers of
one set stand for those of another:

1. Equal sets are one class, found by a 128-bit digest.
2. Shingles are ordered by a sketch of how often they occur (any fixed order
   gives exact results; rare first keeps lists short).  Sets that link share a
   shingle in their prefixes, so an index lists, by shingle, set, size and
   position.
3. Index skipping: a list is sorted by size and cut into blocks; a block whose
   sizes, or whose least position, cannot reach the overlap asked for is skipped
   as a whole.  In a short list all fitting pairs are tried, in a long one each
   set against the first fitting set, its leader.  Pairs from short lists whose
   counts of shingles by bucket already rule out the overlap are dropped.
4. Answer skipping: members tried against one leader form runs of bounded size.
   Each is kept as its difference from the leader, and its overlaps with the other
   members of the run are derived from the leader's by those differences alone.
   So a run settles all its members' connections, and members of one component are
   not compared with each other.
5. Pairs of a list that are in one component, or met in one run, are never looked
   at again; all others are verified.  So no link between components is lost.

Defined results: null and empty texts have no set and link with nothing; with
fewer words than the shingle, the whole sequence is the one shingle; repeated
rows are copies; the component of documents without an id is the least id in
it, null if none has one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .store import discard, saved
from .textops import chunks, mix64, shingle_sets, signed, words

SKETCH_BITS = 20  # the broadcast sketch has 2**SKETCH_BITS bytes
_SLICES = 64
_BLOCK = 64
_SHORT, _LONG = 8, 4096
_U = np.uint64


def _slot(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> _U(64 - bits)).astype(np.int64)


def frequency_sketch(docs: DataFrame, size: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each of ``2**bits`` slots the logarithm, as a byte, of the number of
    shingles in it, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts = batch.column(0).fill_null("")
            for b, e in chunks(texts):
                values, _ = shingle_sets(words(texts.slice(b, e - b), lower=True), size)
                total += np.bincount(_slot(values, bits), minlength=1 << bits)
        parts = total.astype(np.int64).reshape(_SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        for k, v in sums.items():
            level = np.minimum(np.log2(v + 1.0) * 8, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(8, "slice").mapInArrow(add, "slice int, levels binary")
    out = np.zeros((_SLICES, (1 << bits) // _SLICES), np.uint8)
    for row in parts.collect():  # _SLICES rows, 2**bits bytes together
        out[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of which a linked set must share one."""
    return n - (percent * n + 99) // 100 + 1


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with 100 * overlap >= percent * union."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


#: Buckets of a set's profile, one byte each; 255 stands for that many or more.
PROFILE = 32


def profile(values: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall in each bucket."""
    return np.minimum(np.bincount((values & _U(PROFILE - 1)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8)


def _reachable(percent: int) -> Callable:
    """Pairs (leader, member, their sizes and profiles) whose overlap may suffice:
    it is at most the sum of the lesser counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, PROFILE) for k in (4, 5))
            low = np.minimum(x, y)
            keep = (low.sum(axis=1, dtype=np.int64) >= least_overlap(a, b, percent)) | (low == 255).any(axis=1)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (leader, member) that their profiles do not rule out."""
    side = lambda c: classes.select(F.col("sid").alias(c), F.col("n").alias(f"{c}_n"), F.col("profile").alias(f"{c}_profile"))
    met = pairs.join(side("leader"), "leader").join(side("member"), "member")
    return met.select("leader", "member", "leader_n", "member_n", "leader_profile", "member_profile").mapInArrow(_reachable(percent), "leader long, member long")


_SET = "doc_id long, digest long, high long, low long, n int, prefix binary, profile binary"


def _scan_sets(sketch, size: int, percent: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, sent = sketch.value, set()
        for batch in batches:
            texts = batch.column(2).fill_null("")
            for b, e in chunks(texts):
                values, bounds = shingle_sets(words(texts.slice(b, e - b), lower=True), size)
                n = np.diff(bounds)
                total = np.concatenate([[_U(0)], np.cumsum(values)])
                mixed = np.concatenate([[_U(0)], np.cumsum(mix64(values + _U(0x632BE59BD9B4E019)))])
                high = mix64(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64))
                low = mix64(mixed[bounds[1:]] - mixed[bounds[:-1]])
                rank = levels[_slot(values, bits)]
                keep = prefix_length(n, percent)
                prefixes: list[bytes | None] = []
                profiles: list[bytes | None] = []
                for k, key in enumerate(zip(high.tolist(), low.tolist(), strict=True)):
                    if not n[k] or key in sent:
                        prefixes.append(None)
                        profiles.append(None)
                        continue
                    sent.add(key)
                    own, at = values[bounds[k] : bounds[k + 1]], rank[bounds[k] : bounds[k + 1]]
                    prefixes.append(own[np.argsort(at, kind="stable")[: keep[k]]].tobytes())
                    profiles.append(profile(own).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b, e - b), batch.column(1).slice(b, e - b), pa.array(signed(high)), pa.array(signed(low)), pa.array(n.astype(np.int32)), pa.array(prefixes, pa.binary()), pa.array(profiles, pa.binary())],
                    names=["doc_id", "digest", "high", "low", "n", "prefix", "profile"],
                )

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of sets (sid, n, prefix)."""
    for batch in batches:
        for b in range(0, batch.num_rows, 512):
            part = batch.slice(b, 512)
            blobs = part.column(2).to_pylist()
            count = np.array([len(x) // 8 for x in blobs])
            value = np.frombuffer(b"".join(blobs), np.uint64)
            position = np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
            sid, n = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(signed(value.copy())), pa.array(np.repeat(sid, count)), pa.array(np.repeat(n, count)), pa.array(position.astype(np.int32))], names=["shingle", "sid", "n", "position"])


def _lists(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of the rows of each run of whole lists; rows come sorted by shingle."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if kept is not None:
            got = [np.concatenate([a, b]) for a, b in zip(kept, got, strict=True)]
        if not len(got[0]):
            continue
        cut = int(np.searchsorted(got[0], got[0][-1], side="left"))
        kept = [a[cut:] for a in got]
        if cut:
            yield [a[:cut] for a in got]
    if kept is not None and len(kept[0]):
        yield kept


def _groups(shingle: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1], [True]]))
    many = np.flatnonzero(np.diff(edge) > 1)
    return zip(edge[many].tolist(), edge[many + 1].tolist(), strict=True)


class _List:
    """One index list in order of size, with the least position of each block."""

    def __init__(self, n: np.ndarray, position: np.ndarray, percent: int):
        self.n, self.position, self.percent = n, position, percent
        self.room = n - position  # shingles from the shared one on
        starts = np.arange(0, len(n), _BLOCK)
        self.block_room = np.maximum.reduceat(self.room, starts)
        self.block_least = n[starts]

    def fitting(self, k: int) -> np.ndarray:
        """Entries after k that could still link with it."""
        n, room, percent = int(self.n[k]), int(self.room[k]), self.percent
        stop = int(np.searchsorted(self.n, n * 100 // percent, side="right"))
        if stop <= k + 1:
            return np.zeros(0, np.int64)
        if stop - k > 2 * _BLOCK:
            first = (k + 1) // _BLOCK
            blocks = np.arange(first, (stop - 1) // _BLOCK + 1)
            reach = np.minimum(room, self.block_room[blocks]) >= least_overlap(n, np.maximum(self.block_least[blocks], n), percent)
            at = (blocks[reach][:, None] * _BLOCK + np.arange(_BLOCK)).ravel()
            at = at[(at > k) & (at < stop)]
        else:
            at = np.arange(k + 1, stop)
        return at[np.minimum(room, self.room[at]) >= least_overlap(n, self.n[at], percent)]


_PAIR = "shingle long, sid long, n int, position int, other long"


def _pair_batch(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
    shingle, sid, n, position, other = (np.concatenate(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(sid), pa.array(n.astype(np.int32)), pa.array(position.astype(np.int32)), pa.array(other)], names=["shingle", "sid", "n", "position", "other"])


def _follow(entries: _List) -> tuple[np.ndarray, np.ndarray]:
    """The leader of each entry (itself where it follows none), and whether it
    may fit any other.  In lists of over ``_LONG`` entries every entry near
    another in size counts as one that may."""
    count = len(entries.n)
    leader, follows = np.arange(count), np.zeros(count, bool)
    near = entries.n[:-1] * 100 >= entries.percent * entries.n[1:]
    listed = np.zeros(count, bool)
    if count > _LONG:
        listed[:-1] |= near
        listed[1:] |= near
    for k in range(count - 1):
        if count > _LONG and follows[k]:
            continue
        at = entries.fitting(k)
        if not len(at):
            continue
        listed[k] = listed[at] = True
        if not follows[k]:
            at = at[~follows[at]]
            leader[at], follows[at] = k, True
    return leader, listed


def _leader_pairs(percent: int) -> Callable:
    """From sorted lists: of short ones every fitting pair (position -1); of long
    ones a row for each entry with a fitting partner, where ``other`` is its leader,
    or itself where it leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, sid, n, position in _lists(batches, 4):
            rows = []
            for b, e in _groups(shingle):
                entries = _List(n[b:e].astype(np.int64), position[b:e].astype(np.int64), percent)
                if e - b <= _SHORT:
                    fits = [(k, at) for k in range(e - b - 1) if len(at := entries.fitting(k))]
                    if fits:
                        first = np.concatenate([np.full(len(at), k) for k, at in fits])
                        second = np.concatenate([at for _, at in fits])
                        rows.append([shingle[b:e][second], sid[b:e][second], n[b:e][second], np.full(len(second), -1), sid[b:e][first]])
                    continue
                leader, listed = _follow(entries)
                used = np.flatnonzero(listed)
                if len(used):
                    s = sid[b:e]
                    rows.append([shingle[b:e][used], s[used], n[b:e][used], position[b:e][used], s[leader[used]]])
            if rows:
                yield _pair_batch(rows)

    return run


def _cross_pairs(percent: int) -> Callable:
    """Fitting pairs of sorted lists (shingle, sid, n, position, component, other, run)
    that are in different components and have not met in a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingle, sid, n, position, component, other, part in _lists(batches, 7):
            rows = []
            for b, e in _groups(shingle):
                c = component[b:e]
                if (c == c[0]).all():
                    continue
                entries, s, lead, own = _List(n[b:e].astype(np.int64), position[b:e].astype(np.int64), percent), sid[b:e], other[b:e], part[b:e]
                for k in range(e - b - 1):
                    if (c == c[k]).all():
                        continue
                    at = entries.fitting(k)
                    met = (lead[at] == lead[k]) & ((own[at] == own[k]) | (s[at] == lead[k]) | (s[k] == lead[k]))
                    at = at[(c[at] != c[k]) & ~met]
                    if len(at):
                        rows.append([np.full(len(at), shingle[b]), s[at], n[b:e][at], position[b:e][at], np.full(len(at), s[k])])
                if sum(len(r[0]) for r in rows) > 50_000:
                    yield _pair_batch(rows)
                    rows = []
            if rows:
                yield _pair_batch(rows)

    return run


class _Run:
    """A leader's set and members as differences from it."""

    def __init__(self, sid: int, values: np.ndarray, percent: int):
        self.percent, self.base = percent, values
        self.sids = [sid]
        self.size = [len(values)]
        self.parent = [0]
        self.lacks = np.zeros((64, len(values) // 64 + 1), np.uint64)  # bit sets over the leader's shingles
        self.extra: list[np.ndarray] = [np.zeros(0, np.uint64)]

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def add(self, sid: int, values: np.ndarray) -> list[tuple[int, int]]:
        """Place a member; the links that join it to components of the run."""
        base, percent, k = self.base, self.percent, len(self.sids)
        place = np.minimum(np.searchsorted(base, values), len(base) - 1)
        shared = base[place] == values
        bits = np.ones(self.lacks.shape[1] * 64, np.uint8)
        bits[place[shared]] = 0
        bits[len(base) :] = 0
        lacks, extra = np.packbits(bits, bitorder="little").view(np.uint64), values[~shared]
        if k == len(self.lacks):
            self.lacks = np.concatenate([self.lacks, np.zeros_like(self.lacks)])
        self.lacks[k] = lacks
        self.sids.append(sid)
        self.size.append(len(values))
        self.extra.append(extra)
        self.parent.append(k)
        links: list[tuple[int, int]] = []
        common = len(base) - int(np.bitwise_count(lacks).sum())
        if 100 * common >= percent * (len(base) + len(values) - common):
            links.append((self.sids[0], sid))
            self.parent[k] = self.root(0)
        own = self.root(k)
        rest = np.array([j for j in range(1, k) if self.root(j) != own], np.int64)
        if not len(rest):
            return links
        size = np.array([self.size[j] for j in rest])
        least = least_overlap(size, len(values), percent)
        kept = len(base) - np.bitwise_count(self.lacks[rest] | lacks).sum(axis=1).astype(np.int64)
        spare = np.minimum(np.array([len(self.extra[j]) for j in rest]), len(extra))
        for j, inside, need in zip(rest[kept + spare >= least].tolist(), kept[kept + spare >= least].tolist(), least[kept + spare >= least].tolist(), strict=True):
            if self.root(j) == self.root(k):
                continue
            if inside + len(np.intersect1d(extra, self.extra[j], assume_unique=True)) >= need:
                links.append((self.sids[j], sid))
                self.parent[self.root(j)] = self.root(k)
        return links


def _verify(percent: int) -> Callable:
    """Rows (leader, run, rank, sid, set), sorted so that a run's leader (rank 0)
    comes first; gives links (a, b) that connect what the run connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            sets = batch.column(4)
            for k, (lead, part, rank, sid) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                values = np.frombuffer(sets[k].as_py(), np.uint64)
                if rank == 0:
                    key, state = (lead, part), _Run(sid, values, percent)
                elif (lead, part) == key:
                    found += state.add(sid, values)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


#: Members of a leader that are compared with each other; more are cut into runs.
RUN = 2048


def _in_runs(pairs: DataFrame) -> DataFrame:
    """leader, member, run of pairs (leader, member)."""
    counts = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / RUN)).alias("run"))


def _links(runs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links of (leader, member, run)."""
    members = runs.join(sets, runs["member"] == sets["sid"]).select("leader", "run", F.lit(1).alias("rank"), "sid", "values")
    heads = runs.select("leader", "run").distinct()
    leaders = heads.join(sets, heads["leader"] == sets["sid"]).select("leader", "run", F.lit(0).alias("rank"), "sid", "values")
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.unionByName(leaders).repartition(parts, "leader", "run").sortWithinPartitions("leader", "run", "rank", "sid")
    return dealt.mapInArrow(_verify(percent), "a long, b long")


#: The broadcast filter has eight bits for each digest, in a power of two between these.
FILTER_BITS = 20, 28


def digest_filter(digests: DataFrame) -> np.ndarray:
    """A bit for the top bits of each digest: tells at the scan which texts may be
    wanted.  Others that pass fall out in the join after it.  At most 32 MB."""
    bits = min(max((8 * digests.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    width = (1 << bits) // _SLICES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = _slot(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), bits)
            for k in np.unique(slot // width).tolist():
                own = flags.setdefault(k, np.zeros(width, bool))
                own[slot[slot // width == k] % width] = True
        for k, own in flags.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["slice", "flags"])

    dealt = digests.select(F.shiftrightunsigned("digest", 64 - _SLICES.bit_length() + 1).cast("int").alias("slice"), "digest").repartition(8, "slice")
    out = np.zeros((_SLICES, width), bool)
    for row in dealt.mapInArrow(mark, "slice int, flags binary").collect():  # _SLICES rows, 2**bits bits together
        out[row["slice"]] = np.unpackbits(np.frombuffer(row["flags"], np.uint8)).astype(bool)
    return np.packbits(out.ravel())


def passes(flags: np.ndarray, digests: pa.Array) -> np.ndarray:
    """Which digests (longs) a filter lets pass."""
    slot = _slot(digests.to_numpy(zero_copy_only=False).view(np.uint64), (8 * len(flags)).bit_length() - 1)
    return (flags[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def _set_values(size: int, wanted) -> Callable:
    """Sets of the texts (doc_id, digest, text) that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        for batch in batches:
            some = batch.filter(pa.array(passes(flags, batch.column(1))))
            texts = some.column(2).fill_null("")
            for b, e in chunks(texts):
                values, bounds = shingle_sets(words(texts.slice(b, e - b), lower=True), size)
                blobs = [values[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).slice(b, e - b), some.column(1).slice(b, e - b), pa.array(blobs, pa.binary())], names=["doc_id", "digest", "values"])

    return run


def _linked(docs: DataFrame, size: int, percent: int, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component (null without shingles; its own
    also where two have one least id) and component_id of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, size, bits))
    scanned = saved(docs.mapInArrow(_scan_sets(sketch, size, percent, bits), _SET), "sets")
    classes = scanned.where("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max(F.struct(F.col("prefix").isNotNull().alias("has"), "doc_id", "digest", "prefix", "profile")).alias("one"), F.max("n").alias("n"))
    classes = saved(classes.select("high", "low", "least", "n", F.col("one.doc_id").alias("doc_id"), F.col("one.digest").alias("digest"), F.col("one.prefix").alias("prefix"), F.col("one.profile").alias("profile"), F.monotonically_increasing_id().alias("sid")), "classes")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = classes.select("sid", "n", "prefix").mapInArrow(_entries, "shingle long, sid long, n int, position int")
    tried = index.repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "position", "sid").mapInArrow(_leader_pairs(percent), _PAIR)
    tried = saved(tried, "tried")

    long = tried.where("position >= 0")
    short = tried.where("position < 0").select(F.col("other").alias("leader"), F.col("sid").alias("member")).distinct()
    pairs = saved(_pruned(short, classes, percent).unionByName(long.where("sid <> other").select(F.col("other").alias("leader"), F.col("sid").alias("member"))).distinct(), "pairs")
    wanted = pairs.select(F.col("leader").alias("sid")).unionByName(pairs.select(F.col("member").alias("sid"))).unionByName(long.select("sid")).distinct()
    wanted = saved(wanted.join(classes.select("sid", F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")), "sid"), "wanted")
    passing = spark.sparkContext.broadcast(digest_filter(wanted.select(F.col("_digest").alias("digest"))))
    values = docs.mapInArrow(_set_values(size, passing), "doc_id long, digest long, values binary")
    # Repeated rows give a set twice, which a run does not mind.
    values = values.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")))
    sets = saved(values.select("sid", "values"), "values")

    runs = saved(_in_runs(pairs), "runs")
    links = saved(_links(runs, sets, percent), "links")
    first = components(links)
    known = long.join(first.withColumnRenamed("node", "sid"), "sid", "left").join(runs.select(F.col("leader").alias("other"), F.col("member").alias("sid"), "run"), ["other", "sid"], "left")
    known = known.select("shingle", "sid", "n", "position", F.coalesce("component", "sid").alias("component"), "other", F.coalesce("run", F.lit(-1)).alias("run"))
    cross = known.repartition(parts, "shingle").sortWithinPartitions("shingle", "n", "position", "sid").mapInArrow(_cross_pairs(percent), _PAIR)
    rest = cross.select(F.col("other").alias("leader"), F.col("sid").alias("member")).distinct().join(pairs, ["leader", "member"], "left_anti")
    links = saved(links.unionByName(_links(_in_runs(_pruned(rest, classes, percent)), sets, percent)), "links")
    discard(tried, pairs, wanted, sets, runs)

    final = components(links)
    named = classes.join(final.withColumnRenamed("node", "sid"), "sid", "left").select("high", "low", "least", F.coalesce("component", "sid").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("high", "low", "component", "component_id")
    out = scanned.select("doc_id", "digest", "n", "high", "low").join(named, ["high", "low"], "left")
    return out.select("doc_id", "digest", F.col("n").cast("long").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def linked_components(docs: DataFrame, size: int = 3, percent: int = 90, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return _linked(docs, size, percent, bits).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each component, the least id; documents
    without an id, or without words, stay.  Rows are told apart by id and text: of
    rows with one id, those of one component, or of one text, leave one."""
    found = _linked(docs, size, percent)
    ids = docs.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("distinct")).head()
    repeated = ids["n"] != ids["distinct"]
    loses = F.col("doc_id") != F.col("component_id")
    if repeated:
        found = found.withColumn("_first", F.min("digest").over(Window.partitionBy("doc_id", "component")))
        loses |= F.col("digest") != F.col("_first")
    losers = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & loses).select(F.col("doc_id").alias("_loser"), F.col("digest").alias("_lost")).distinct()
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_digest"), F.struct(*docs.columns).alias("_row"))
    kept = rows.join(losers, (F.col("_id") == F.col("_loser")) & (F.col("_digest") == F.col("_lost")), "left_anti")
    if repeated:
        kept = kept.where("_id is not null").dropDuplicates(["_id", "_digest"]).unionByName(kept.where("_id is null"))
    return kept.select("_row.*")
