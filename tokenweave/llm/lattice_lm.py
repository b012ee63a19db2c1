"""Operator 3: language-model scores from subword lattices.

The model is an existing piece vocabulary with a weight for each piece.  The
lattice of a word has an arc for every piece that occurs in it and, where
training texts have the word, one arc over the whole of it.  The probability is
the sum over all segmentations of the product of their arcs; a forward recursion
in log space gives it.  Words are lower-cased (A-Z) and each begins with a space
mark, which no piece crosses, so a text's log probability is the sum over its
words and its end.

Piece weights start from the vocabulary's own scores and are then fitted by
expectation-maximisation over all distinct training words.  A whole word's arc
weighs its discounted share of training tokens, (count - D) / N; the mass that
discounting frees, D * V / N, is the factor of all paths of pieces.  The paths of
all words sum to one, and every step below keeps that, so scores are log
probabilities over all texts.

Texts differ in language and kind, so there is a common set of whole-word arcs and
one for each of a few latent classes (``latent``), fitted to all training texts
without reading any label; a training text counts for the class that fits it best.  What discounting frees in a class goes to the pieces and, a
tenth of it, to the common arcs.  A text's probability is the mean over the classes
and the common arcs, weighed by training texts.  Within a text, words that were
there before gain: with t words before it, a word's probability is
(tau * P(word) + its count among them) / (tau + t).

Data flow: documents become blocks (word codes and a vocabulary of bounded size), over
which the rounds of the latent classes pass;
the vocabularies meet by word, where corpus counts are summed and each distinct word
is scored once; counts and scores go back to their blocks, packed.  Only the piece
weights, of the vocabulary's size, are broadcast.

Defined results: null text is empty and consists of the end alone; a null id
counts as the empty string for the split; repeated rows count each; without any
training text words are scored by pieces alone, with the starting weights, and an
end has probability 1/1000; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .latent import ASIDE, Mixture, Sums, buckets, learned, sampled, starts
from .pieces import SPACE, vocabulary
from .store import saved
from .textops import chunks

#: A block ends at so many distinct words or words.
BLOCK_VOCABULARY, BLOCK_WORDS = 200_000, 2_000_000
BATCH_WORDS = 30_000
#: Scores of so many words are packed together.
PACK_WORDS = 1_000_000
_LITERAL = "﷐"
_LN10 = float(np.log(10.0))


# --- the lattice --------------------------------------------------------------------------


class Lattice:
    """All segmentations of many words at once."""

    def __init__(self, path: str):
        vocab = vocabulary(path)
        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        for i in vocab.plain:
            self.automaton.add_word(vocab.pieces[i], i)
        self.automaton.make_automaton()
        self.length = np.array([len(p) for p in vocab.pieces])
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c) for c in vocab.single]] = True
        self.known[10] = True

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of the words joined by line feeds: (start, end, piece, word's first place)
        by place of the end within its word; bounds of equal places; characters
        spelled in bytes, as pieces beyond the vocabulary."""
        joined = "\n".join(SPACE + w.replace(SPACE, _LITERAL) for w in words)
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, piece = flat[:, 0] + 1, flat[:, 1]
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        strange = np.flatnonzero(~self.known[code])
        chars, which = np.unique(code[strange], return_inverse=True)
        start = end - self.length[piece]
        if len(strange):
            end = np.concatenate([end, strange + 1])
            start = np.concatenate([start, strange])
            piece = np.concatenate([piece, which + self.vocab.size])
        breaks = np.flatnonzero(code == 10)
        first = np.concatenate([[0], breaks + 1])
        last = np.concatenate([breaks, [len(code)]])
        word = np.cumsum(code == 10)[end - 1]
        place = end - first[word]
        order = np.argsort(place * np.int64(len(joined) + 1) + end)
        start, end, piece, word, place = (x[order] for x in (start, end, piece, word, place))
        spelled = ["".join(map(chr, [c])).replace(_LITERAL, SPACE) for c in chars.tolist()]
        return start, end, piece, word, place, first, last, [self.vocab.fallback(c) for c in spelled]

    def weights(self, logp: np.ndarray, spelled: list[list[int]]) -> np.ndarray:
        return np.concatenate([logp, [logp[ids].sum() for ids in spelled]]) if spelled else logp

    def forward(self, words: list[str], logp: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
        """Log probability of each word; the edges; forward values by place."""
        got = self.edges(words)
        return self.along(got, logp)

    def along(self, got: tuple, logp: np.ndarray) -> tuple[np.ndarray, tuple, np.ndarray]:
        """As ``forward``, over edges that are known already."""
        start, end, piece, _, place, first, last, spelled = got
        weight = self.weights(logp, spelled)[piece]
        alpha = np.full(int(last[-1]) + 1, -np.inf)
        alpha[first] = 0.0
        for b, e in _runs(place):
            alpha[end[b:e][_heads(end[b:e])]] = _logsum(alpha[start[b:e]] + weight[b:e], _heads(end[b:e]))
        return alpha[last], got, alpha

    def expected(self, words: list[str], count: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected piece counts over the words, each occurring ``count`` times, and
        the log likelihood."""
        total, got, alpha = self.forward(words, logp)
        start, end, piece, word, _, first, last, spelled = got
        weight = self.weights(logp, spelled)[piece]
        beta = np.full(len(alpha), -np.inf)
        beta[last] = 0.0
        back = np.argsort((start - first[word]) * np.int64(len(alpha)) + start)[::-1]
        s, e, w = start[back], end[back], weight[back]
        for x, y in _runs((s - first[word[back]])):
            heads = _heads(s[x:y])
            beta[s[x:y][heads]] = _logsum(beta[e[x:y]] + w[x:y], heads)
        with np.errstate(invalid="ignore"):
            share = np.exp(alpha[start] + weight + beta[end] - total[word])
        share = np.where(np.isfinite(share), share, 0.0) * count[word]
        sums = np.bincount(piece, share, minlength=self.vocab.size + len(spelled))
        out = sums[: self.vocab.size]
        for k, ids in enumerate(spelled):
            for i in ids:
                out[i] += sums[self.vocab.size + k]
        return out, float((total * count)[count > 0].sum())


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def _heads(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _logsum(value: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of each run that begins at a head."""
    top = np.maximum.reduceat(value, heads)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.add.reduceat(np.exp(value - np.repeat(safe, np.diff(np.append(heads, len(value))))), heads))


@cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


def starting_weights(path: str) -> np.ndarray:
    """Log weights from the vocabulary's scores.  Scores that are log probabilities
    (they sum to about one) are taken as they are; other scores, such as the ranks
    that merge-based vocabularies have, give an order, which Zipf's law weighs."""
    vocab = vocabulary(path)
    spelled = set(vocab.byte_ids.values())
    usable = np.array(sorted([*vocab.plain, *spelled]))
    score = np.array([-np.inf if i in spelled else vocab.scores[i] for i in usable.tolist()])
    logp = np.full(vocab.size, -np.inf)
    if 0.5 < np.exp(np.minimum(score, 0.0)).sum() < 1.5:
        value = np.where(np.isfinite(score), score, score[np.isfinite(score)].min())
    else:
        value = -np.log(np.argsort(np.argsort(-score, kind="stable"), kind="stable") + 10.0)
    logp[usable] = value - np.log(np.exp(value).sum())
    return logp


# --- whole words ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Share:
    """Discounted shares of training words; ends count as words."""

    n: int
    v: int
    docs: int
    discount: float

    @staticmethod
    def of(n: int, v: int, once: int, twice: int, docs: int) -> Share:
        discount = max(once, 1) / (max(once, 1) + 2 * twice)
        return Share(n + docs, v + (docs > 0), docs, min(max(discount, 0.1), 0.9))

    def words(self, count: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Log probability of words that occur ``count`` times: the arc over the whole
        word, and what the freed mass is spread by."""
        if not self.n:
            return below
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(count - self.discount, 0.0) / self.n), np.log(self.discount * self.v / self.n) + below)

    def spread(self, count: np.ndarray, pieces: np.ndarray, part: float = 0.1) -> np.ndarray:
        """``part`` by these words' discounted shares and the rest by pieces."""
        kept = self.n - self.discount * self.v
        if kept <= 0:
            return pieces
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(part * np.maximum(count - self.discount, 0.0) / kept), np.log(1 - part) + pieces)


@dataclass(frozen=True)
class Shares:
    common: Share
    classes: list[Share]

    def words(self, count: np.ndarray, kinds: list[np.ndarray], pieces: np.ndarray) -> np.ndarray:
        """Log probability of words, a row for the common arcs and one for each class."""
        below = self.common.spread(count, pieces)
        return np.stack([self.common.words(count, pieces), *(c.words(n, below) for c, n in zip(self.classes, kinds, strict=True))])

    def starts(self) -> np.ndarray:
        """Log probability of each row's kind of text, and of an end in it."""
        if not self.common.n:
            return np.full(1 + len(self.classes), np.log(1e-3) - np.log(1 + len(self.classes)))
        none = np.full(1, -np.inf)
        ends = self.words(np.array([self.common.docs]), [np.array([c.docs]) for c in self.classes], none)[:, 0]
        docs = np.array([0, *(c.docs for c in self.classes)], float) + 1.0
        return np.log(docs / docs.sum()) + ends


# --- documents to blocks -------------------------------------------------------------------

_BLOCK = "block long, payload binary, words string"


def _packed(parts: list[np.ndarray]) -> bytes:
    """Arrays end to end behind their sizes in bytes."""
    raw = [p.tobytes() for p in parts]
    return np.array([len(r) for r in raw], "<i8").tobytes() + b"".join(raw)


def _unpacked(raw: bytes, kinds: list[str]) -> list[np.ndarray]:
    size = np.frombuffer(raw, "<i8", len(kinds))
    edge = 8 * len(kinds) + np.concatenate([[0], np.cumsum(size)])
    return [np.frombuffer(raw[a:b], kind) for a, b, kind in zip(edge[:-1].tolist(), edge[1:].tolist(), kinds, strict=True)]


_PAYLOAD = ["<i8", "u1", "<i8", "<u4"]  # ids, flags (1: held out, 2: null id), lengths, word codes
_SCORES = ["<u4", "<i8", "<f4"]  # word codes, corpus counts, log probabilities by class


class _Block:
    def __init__(self):
        self.code: defaultdict[bytes, int] = defaultdict(int)
        self.code.default_factory = self.code.__len__
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, held: bool, text: str) -> None:
        found = text.encode().lower().split()
        self.ids.append(doc_id)
        self.held.append(held)
        self.codes.append(np.fromiter(map(self.code.__getitem__, found), np.uint32, len(found)))
        self.size += len(found)

    def full(self) -> bool:
        return len(self.code) > BLOCK_VOCABULARY or self.size > BLOCK_WORDS

    def row(self) -> pa.RecordBatch:
        flat, length = np.concatenate(self.codes), np.array([len(c) for c in self.codes], "<i8")
        null = np.array([x is None for x in self.ids])
        flags = np.array(self.held).astype(np.uint8) | (null.astype(np.uint8) << 1)
        payload = _packed([np.array([x or 0 for x in self.ids], "<i8"), flags, length, flat.astype("<u4")])
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([payload], pa.binary()), pa.array(["\n".join(map(bytes.decode, self.code))])], names=["block", "payload", "words"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to block rows."""
    block = _Block()
    for batch in batches:
        texts = batch.column(2).fill_null("")
        ids, held = (batch.column(k).to_pylist() for k in range(2))
        for b, e in chunks(texts):
            for k, text in enumerate(texts.slice(b, e - b).to_pylist(), b):
                block.add(ids[k], held[k], text)
                if block.full():
                    yield block.row()
                    block = _Block()
    if block.ids:
        yield block.row()


# --- latent classes ------------------------------------------------------------------------

#: Words of texts that meet a mixture at a time.
CLASS_WORDS = 250_000


def _texts(payload: bytes, words: str) -> tuple[np.ndarray, ...]:
    """Of a block: ids, held out, lengths, word codes and the bucket of each code."""
    ids, flags, length, flat = _unpacked(payload, _PAYLOAD)
    listed = words.encode().split(b"\n") if words else []
    return ids, (flags & 1) > 0, length, flat, buckets(listed, len(listed))


def _class_sums(shared, whole: bool) -> Callable:
    """Block rows (payload, words) to rows (part, sums): of each mixture what ``Sums`` holds of
    all training texts; one text in ``ASIDE`` is kept aside unless ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixtures: list[Mixture] = shared.value
        out = [Sums.none(m.classes) for m in mixtures]
        for batch in batches:
            for payload, words in zip(batch.column(0), batch.column(1), strict=True):
                ids, held, length, flat, bucket = _texts(payload.as_py(), words.as_py())
                training = ~held
                bucket, ids, length = bucket[flat[np.repeat(training, length)]], ids[training], length[training]
                aside = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(ASIDE) == 0
                if whole:
                    aside[:] = False
                edge = np.concatenate([[0], np.cumsum(length)])
                b = 0
                while b < len(length):
                    e = max(b + 1, int(np.searchsorted(edge, edge[b] + CLASS_WORDS, side="right")) - 1)
                    for s, m in zip(out, mixtures, strict=True):
                        s.add(m, bucket[edge[b] : edge[e]], length[b:e], aside[b:e])
                    b = e
        rows = [r for s in out for r in s.rows()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary())], names=["part", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, "<f8") for x in table.column("sums").to_pylist()], axis=0)
    return pa.table([table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def latent_classes(blocks: DataFrame, first: list[Mixture]) -> Mixture:
    """The mixture of all training texts, by rounds over all blocks."""
    context = blocks.sparkSession.sparkContext

    def sums(mixtures: list[Mixture], whole: bool) -> list[Sums]:
        told = blocks.select("payload", "words").mapInArrow(_class_sums(context.broadcast(mixtures), whole), "part int, sums binary")
        found = {r["part"]: np.frombuffer(bytes(r["sums"]), "<f8") for r in told.groupBy("part").applyInArrow(_added, "part int, sums binary").collect()}  # a row for each class and mixture
        if not found:
            return [Sums.none(m.classes) for m in mixtures]
        out, at = [], 0
        for m in mixtures:
            out.append(Sums.of([found[k] for k in range(at, at + m.classes + 1)]))
            at += m.classes + 1
        return out

    return learned(first, sums)


def _class_docs(shared) -> Callable:
    """Block rows (payload, words) to rows (kind, docs): training texts by the class that fits best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture: Mixture = shared.value
        docs = np.zeros(mixture.classes, np.int64)
        for batch in batches:
            for payload, words in zip(batch.column(0), batch.column(1), strict=True):
                _, held, length, flat, bucket = _texts(payload.as_py(), words.as_py())
                docs += np.bincount(mixture.best(bucket[flat], length)[~held], minlength=mixture.classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(mixture.classes, dtype=np.int32)), pa.array(docs)], names=["kind", "docs"])

    return run


def _count_names(classes: int) -> list[str]:
    return [f"n{k}" for k in range(classes)]


def _vocabulary_rows(shared) -> Callable:
    """Block rows (block, payload, words) to (word, block, code, n0, ...): counts in training texts by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture: Mixture = shared.value
        classes = mixture.classes
        for batch in batches:
            for block, payload, words in zip(*(batch.column(k) for k in range(3)), strict=True):
                _, held, length, flat, bucket = _texts(payload.as_py(), words.as_py())
                if not len(bucket):
                    continue
                all_words = len(bucket)
                own = np.where(held, classes, mixture.best(bucket[flat], length))
                n = np.bincount(np.repeat(own, length) * all_words + flat, minlength=(classes + 1) * all_words).reshape(-1, all_words)[:classes]
                listed = pa.array(words.as_py().split("\n"), pa.string())
                for b in range(0, all_words, 50_000):
                    part = n[:, b : b + 50_000]
                    size = part.shape[1]
                    yield pa.RecordBatch.from_arrays([listed.slice(b, size), pa.array(np.full(size, block.as_py())), pa.array(np.arange(b, b + size, dtype=np.int32)), *map(pa.array, part)], names=["word", "block", "code", *_count_names(classes)])

    return run


# --- words of the corpus -------------------------------------------------------------------


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, pa.RecordBatch]]:
    """From rows sorted by word (word, ...): batches of distinct words, and for each
    row the number of its word."""
    for batch in batches:
        for b in range(0, batch.num_rows, BATCH_WORDS):
            part = batch.slice(b, BATCH_WORDS)
            word = part.column(0).dictionary_encode()
            yield word.dictionary.to_pylist(), word.indices.to_numpy(zero_copy_only=False), part


def _expect(path: str, shared) -> Callable:
    """Distinct words (word) to expected piece counts, each word counting once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, logp = lattice(path), shared.value
        total = np.zeros(use.vocab.size)
        for words, _, _ in _distinct(batches):
            total += use.expected(words, np.ones(len(words)), logp)[0]
        piece = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(total[piece])], names=["piece", "expected"])

    return run


def _score(path: str, shared, shares: Shares) -> Callable:
    """Rows (word, block, code, n0, ...) sorted by word to rows (block, own, body): for
    each block the codes, counts and log probabilities of many of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, kept, size = lattice(path), [], 0
        for words, which, part in _distinct(batches):
            first = np.empty(len(words), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            kinds = [part.column(3 + k).to_numpy(zero_copy_only=False)[first] for k in range(len(shares.classes))]
            count = np.sum(kinds, axis=0)
            value = shares.words(count, kinds, use.forward(words, shared.value)[0]).T.astype("<f4")
            kept.append((*(part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)), count[which], value[which]))
            size += len(which)
            if size >= PACK_WORDS:
                yield _by_block(kept)
                kept, size = [], 0
        if kept:
            yield _by_block(kept)

    return run


def _by_block(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    block, *rest = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.argsort(block, kind="stable")
    block, rest = block[order], [x[order].astype(kind) for x, kind in zip(rest, _SCORES, strict=True)]
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    bodies = [_packed([x[b:e] for x in rest]) for b, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]]), pa.array(np.zeros(len(bodies), np.int32)), pa.array(bodies, pa.binary())], names=["block", "own", "body"])


def _finish(shares: Shares, tau: float) -> Callable:
    """Rows (block, own, body) sorted by block, the block's own row last: scores of
    its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: list[bytes] = []
        for batch in batches:
            for own, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own:
                    yield _scored(bodies, body.as_py(), shares, tau)
                    bodies = []
                else:
                    bodies.append(body.as_py())

    return run


def _scored(bodies: list[bytes], payload: bytes, shares: Shares, tau: float) -> pa.RecordBatch:
    ids, flags, length, code = _unpacked(payload, _PAYLOAD)
    parts = [_unpacked(x, _SCORES) for x in bodies]
    size, rows = sum(len(p[0]) for p in parts), 1 + len(shares.classes)
    count, logp = np.zeros(size, np.int64), np.zeros((rows, size))
    for place, n, value in parts:
        count[place], logp[:, place] = n, value.reshape(-1, rows).T
    n, v, docs = shares.common.n, shares.common.v, shares.common.docs
    base = np.log10((count + 1.0) / (n + v + 1.0))
    base_score = np.full(len(ids), float(np.log10((docs + 1.0) / (n + v + 1.0))))
    known = np.full(len(ids), int(docs > 0))
    score = shares.starts()[:, None] + np.log(tau / (tau + length))
    some, at = np.flatnonzero(length), (np.cumsum(length) - length)[length > 0]
    if len(some):
        base_score[some] += np.add.reduceat(base[code], at)
        known[some] += np.add.reduceat((count > 0).astype(np.int64)[code], at)
        for k, value in enumerate(_adapted(code, length, logp, tau)):
            score[k, some] += np.add.reduceat(value, at)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, mask=(flags & 2) > 0), pa.array((flags & 1) > 0), pa.array(length + 1), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), n)), pa.array(base_score), pa.array(np.logaddexp.reduce(score) / _LN10)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _adapted(code: np.ndarray, length: np.ndarray, logp: np.ndarray, tau: float) -> Iterator[np.ndarray]:
    """For each row of ``logp`` the log probability of each word after those before it in its text."""
    doc = np.repeat(np.arange(len(length)), length)
    t = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    key = doc * np.int64(logp.shape[1]) + code
    order = np.argsort(key, kind="stable")
    fresh = _heads(key[order])
    before = np.empty(len(code), np.int64)
    before[order] = np.arange(len(code)) - np.repeat(fresh, np.diff(np.append(fresh, len(code))))
    with np.errstate(divide="ignore"):
        seen, most = np.log(before), np.log(tau + t)
    for row in logp:
        yield np.logaddexp(np.log(tau) + row[code], seen) - most


#: The lattice counts as much as so many words of the text itself.
TAU = 2000.0


def lm_scores(docs: DataFrame, model: str, rounds: int = 2, prior: float = 0.01, tau: float = TAU, sample: int = 2000, most_classes: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    About ``sample`` training texts give the starting points of the latent classes; the
    classes, their number and all else are learned from all of them.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    training = docs.where(~held)
    first = starts(sampled(training, training.count(), F.col("doc_id"), sample), most_classes)
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(_blocks, _BLOCK)
    blocks = saved(blocks, "blocks")
    mixture = latent_classes(blocks, first)
    classes, kinds = mixture.classes, spark.sparkContext.broadcast(mixture)

    # One exchange: all rows of a word come together, are summed, and one of them is its head.
    names = _count_names(classes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = blocks.select("block", "payload", "words").mapInArrow(_vocabulary_rows(kinds), "word string, block long, code int, " + ", ".join(f"{c} long" for c in names)).repartition(parts, "word")
    together = Window.partitionBy("word")
    summed = entries.select("word", "block", "code", *(F.sum(c).over(together).alias(c) for c in names), (F.row_number().over(together.orderBy("block", "code")) == 1).alias("head"))
    corpus = saved(summed, "words")
    heads = corpus.where("head").withColumn("n", sum((F.col(c) for c in names[1:]), F.col(names[0])))

    many = lambda c: F.sum(c.cast("long"))
    told = heads.agg(*(x.alias(f"{c}_{y}") for c in ("n", *names) for y, x in (("n", F.sum(c)), ("v", many(F.col(c) > 0)), ("once", many(F.col(c) == 1)), ("twice", many(F.col(c) == 2))))).head()
    found = blocks.select("payload", "words").mapInArrow(_class_docs(kinds), "kind int, docs long").groupBy("kind").agg(F.sum("docs").alias("docs"))
    docs_in = [0] * classes
    for r in found.collect():  # a row for each class
        docs_in[r["kind"]] = r["docs"]
    share = lambda c, d: Share.of(*(int(told[f"{c}_{y}"] or 0) for y in ("n", "v", "once", "twice")), int(d or 0))
    shares = Shares(share("n", sum(docs_in)), [share(c, d) for c, d in zip(names, docs_in, strict=True)])

    logp = starting_weights(model)
    usable = np.isfinite(logp)
    if shares.common.v > 1:
        for _ in range(rounds):
            expected = heads.where("n > 0").select("word").mapInArrow(_expect(model, spark.sparkContext.broadcast(logp)), "piece int, expected double")
            weight = np.where(usable, prior, 0.0)
            for row in expected.groupBy("piece").agg(F.sum("expected").alias("expected")).collect():  # a row for each piece at most
                weight[row["piece"]] += row["expected"]
            with np.errstate(divide="ignore"):
                logp = np.log(weight / weight.sum())

    shared = spark.sparkContext.broadcast(logp)
    # The rows of a file are those of whole words in order, as the window left them.
    values = corpus.select("word", "block", "code", *names).mapInArrow(_score(model, shared, shares), "block long, own int, body binary")
    both = values.unionByName(blocks.select("block", F.lit(1).alias("own"), F.col("payload").alias("body")))
    met = both.repartition(parts, "block").sortWithinPartitions("block", "own")
    return met.mapInArrow(_finish(shares, tau), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
