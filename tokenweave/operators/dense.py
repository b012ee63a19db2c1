"""Search where queries meet a large share of all documents.

``search`` joins every query with the postings of its clusters, a row for each
probed token.  Where half of the clusters are probed, these are most pairs of
queries and tokens.  Here documents come whole, one row each, and meet a block of
queries in one matrix product; what is not probed is masked.  Only packed lists of
scores are shuffled, to their query, where ranking and quota are taken.  Results are
those of ``search``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import quantize
from .build import BROADCAST_BYTES, centroid_blocks, squared_distances, vectors
from .search import CELLS, TOKENS_AT_ONCE, _bytes, _runs, best_of, one_bit_scores

def documents(tokens: DataFrame, *columns: str, parts: int) -> DataFrame:
    """One row per document: doc_id and, in token order, an array of each column's values; in
    ``parts`` partitions, as few bytes here mean much arithmetic."""
    rows = F.array_sort(F.collect_list(F.struct("token_id", *(c for c in columns if c != "token_id"))))
    packed = tokens.repartition(parts, "doc_id").groupBy("doc_id").agg(rows.alias("t"))
    return packed.select("doc_id", *(F.col(f"t.{c}").alias(c) for c in columns))


# --- probing --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Asked:
    """Tokens of a block of queries, query after query."""

    ids: np.ndarray
    first: np.ndarray  # place of each query's first token
    x: np.ndarray
    probed: np.ndarray  # by token and cluster

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first, append=len(self.x))


def _nearer(shared, nprobe: int, first: bool) -> Callable:
    """Rows (query_id, q_pos, rotated, clusters, distances), the last two packed and, unless
    ``first``, those found so far; with the nearest of one more block of centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            rows = max(1, CELLS // (len(ids) + nprobe))
            for b in range(0, batch.num_rows, rows):
                part = batch.slice(b, rows)
                distance = squared_distances(vectors(part.column(2)), matrix)
                cluster = np.broadcast_to(ids.astype("<i4"), distance.shape)
                if not first:  # blocks come in order of cluster_id, so ties stay in that order
                    cluster, distance = (np.hstack([np.frombuffer(b"".join(part.column(k).to_pylist()), kind).reshape(len(new), -1), new]) for k, kind, new in ((3, "<i4", cluster), (4, "<f8", distance)))
                best = np.argsort(distance, axis=1, kind="stable")[:, :nprobe]
                packed = (pa.array([r.tobytes() for r in np.take_along_axis(x, best, 1)], pa.binary()) for x in (cluster, distance))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *packed], names=["query_id", "q_pos", "rotated", "clusters", "distances"])

    return run


def _bits(n_clusters: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, CELLS // n_clusters)
            for b in range(0, batch.num_rows, rows):
                part = batch.slice(b, rows)
                flags = np.zeros((part.num_rows, n_clusters), bool)
                np.put_along_axis(flags, np.frombuffer(b"".join(part.column(2).to_pylist()), "<i4").reshape(part.num_rows, -1).astype(np.int64), True, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in np.packbits(flags, axis=1)], pa.binary())], names=["query_id", "q_pos", "bits"])

    return run


def asked(matrices: dict, states: DataFrame, centroids: DataFrame, n_clusters: int, nprobe: int, limit: int = BROADCAST_BYTES) -> Asked:
    """The queries of ``query_matrices`` with the clusters that each of their tokens probes, as
    ``search.probe`` has them.  A query token stays one row and comes to the driver as a bit for
    each cluster."""
    kinds = ", ".join(f"{c} {states.schema[c].dataType.simpleString()}" for c in ("query_id", "q_pos"))
    near, first = states.select("query_id", "q_pos", "rotated"), True
    for block in centroid_blocks(centroids, "rotated", limit):
        shared = states.sparkSession.sparkContext.broadcast(block)
        near, first = near.mapInArrow(_nearer(shared, nprobe, first), f"{kinds}, rotated array<double>, clusters binary, distances binary"), False
    rows = near.select("query_id", "q_pos", "clusters").mapInArrow(_bits(n_clusters), f"{kinds}, bits binary").toArrow()
    rows = rows.sort_by([("query_id", "ascending"), ("q_pos", "ascending")])
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    ids = np.array(sorted(matrices), np.int64)
    size = np.array([len(matrices[q][0]) for q in ids.tolist()], np.int64)
    x = np.concatenate([matrices[q][0] for q in ids.tolist()])
    if len(bits) != len(x):
        raise ValueError("a query token has no probes")
    return Asked(ids, np.cumsum(size) - size, x, np.unpackbits(bits, axis=1, count=n_clusters).astype(bool))


# --- scores of all candidates ---------------------------------------------------------------


_KINDS = {"docs": "<i8", "partial": "<f8", "one": "<f8"}

#: Document tokens whose scores make one list of each query, and scores computed at a time: few
#: enough to stay in a core's cache.
LISTED, TILE = 4096, 1 << 17


def _level(size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """An order of documents or queries, longest first; the places of their first tokens, then
    of their second ones and so on; and how many there are of each."""
    order = np.argsort(-size, kind="stable")
    size, start = size[order], start[order]
    many = [int(np.searchsorted(-size, -k)) for k in range(int(size[0]))]
    return order, np.concatenate([start[:m] + k for k, m in enumerate(many)]), many


def _folded(rows: np.ndarray, many: list[int], fold: np.ufunc) -> np.ndarray:
    """Rows in the places of ``_level``, folded into a row for each document or query."""
    out, at = rows[: many[0]].copy(order="K"), many[0]
    for m in many[1:]:
        fold(out[:m], rows[at : at + m], out=out[:m])
        at += m
    return out


def _candidates(shared, dim: int, with_one: bool = True) -> Callable:
    names = ["query_id", *(_KINDS if with_one else ("docs", "partial"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Asked = shared.value
        asks = np.logical_or.reduceat(a.probed, a.first, axis=0)
        turn = np.argsort(-a.size, kind="stable")
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for b, e in _runs(sizes, LISTED):
                part = batch.slice(b, e - b)
                order, place, many = _level(sizes[b:e], np.cumsum(sizes[b:e]) - sizes[b:e])
                doc = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")[order]
                cluster, f1 = (part.column(k).flatten().to_numpy(zero_copy_only=False)[place] for k in (1, 3))
                words = part.column(2).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(f1), -1)[place]
                code = np.ascontiguousarray(((quantize.unpack_words(words, dim) - 0.5) * f1[:, None]).T)
                partial, *one = (np.empty((len(a.ids), len(doc))) for _ in names[2:])
                for g, h in _runs(a.size[turn], max(1, TILE // len(f1))):
                    own = turn[g:h]  # longest first, so ``_level`` keeps their order
                    _, at, tokens = _level(a.size[own], a.first[own])
                    score = a.x[at] @ code
                    if with_one:
                        one[0][own] = _folded(_folded(score.T, many, np.maximum).T, tokens, np.add)
                    score *= a.probed[at].take(cluster, axis=1)
                    partial[own] = _folded(np.maximum(_folded(score.T, many, np.maximum).T, 0.0), tokens, np.add) + 0.0
                met = _folded(asks[:, cluster].T, many, np.logical_or).T
                rows = [(k, slice(None) if own.all() else np.flatnonzero(own)) for k, own in enumerate(met) if own.any()]
                if rows:
                    columns = [[doc[at].tobytes() for _, at in rows], *([x[k, at].tobytes() for k, at in rows] for x in (partial, *one))]
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[[k for k, _ in rows]]), *(pa.array(c, pa.binary()) for c in columns)], names=names)

    return run


def candidates(docs: DataFrame, shared, dim: int, with_one: bool = True) -> DataFrame:
    """query_id, docs, partial, one: lists of candidates of a query, packed, with the sum of
    their probed tokens' best scores and, if ``with_one``, with their one-bit MaxSim.  ``docs``
    has cluster_id, code1, f1; ``shared`` is an ``Asked``."""
    kinds = "query_id long, docs binary, partial binary" + ", one binary" * with_one
    return docs.select("doc_id", "cluster_id", "code1", "f1").mapInArrow(_candidates(shared, dim, with_one), kinds)


def _list(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), _KINDS[name])


def partial_scores(lists: DataFrame, query_kind: str = "int", doc_kind: str = "int") -> DataFrame:
    """query_id, doc_id, partial of every candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 1024):
                part = batch.slice(b, 1024)
                size = [len(x) // 8 for x in part.column("docs").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(_list(part, "docs")), pa.array(_list(part, "partial"))], names=["query_id", "doc_id", "partial"])

    flat = lists.select("query_id", "docs", "partial").mapInArrow(run, "query_id long, doc_id long, partial double")
    return flat.select(F.col("query_id").cast(query_kind).alias("query_id"), F.col("doc_id").cast(doc_kind).alias("doc_id"), "partial")


# --- ranking --------------------------------------------------------------------------------


def taken(one: np.ndarray, k_full_bit: int, num_chunks: int) -> np.ndarray:
    """Which documents of a query, given in refined order by their one-bit scores, are rescored;
    as ``search.chunk_quota``."""
    n, out = len(one), np.zeros(len(one), bool)
    top, chunks = min(n, k_full_bit), min(n, num_chunks)
    order = np.argsort(-np.round(one, 9), kind="stable")
    for c in range(chunks):
        seen = order[order < (c + 1) * -(-n // chunks)]
        out[seen[: top * (c + 1) // chunks]] = True
    return out


def _best(doc: np.ndarray, partial: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` by (partial DESC, doc_id ASC); only those that reach the k-th are sorted."""
    down, own = -np.round(partial, 9), np.arange(len(doc))
    if k < len(doc):
        own = np.flatnonzero(down <= np.partition(down, k - 1)[k - 1])
    return own[np.lexsort((doc[own], down[own]))[:k]]


def _by_query(lists: DataFrame, pick: Callable[[pa.Table], list[pa.Array]], columns: str, query_kind: str, doc_kind: str) -> DataFrame:
    """query_id, doc_id and ``columns``, as ``pick`` gives them for a query's lists, which come
    together in one group."""
    names = ["query_id", "doc_id", *(c.split()[0] for c in columns.split(", ") if c)]

    def run(table: pa.Table) -> pa.Table:
        out = pick(table)
        return pa.table([pa.array(np.full(len(out[0]), table.column("query_id")[0].as_py(), np.int64)), *out], names=names)

    flat = lists.groupBy("query_id").applyInArrow(run, ", ".join(filter(None, ["query_id long, doc_id long", columns])))
    return flat.select(F.col("query_id").cast(query_kind).alias("query_id"), F.col("doc_id").cast(doc_kind).alias("doc_id"), *names[2:])


def ranked(lists: DataFrame, k_refine: int, query_kind: str = "int", doc_kind: str = "int") -> DataFrame:
    """query_id, doc_id, prank (from 0) of the best candidates by (partial DESC, doc_id ASC); and
    their score (one-bit) where lists have it."""
    scored = "one" in lists.columns

    def pick(table: pa.Table) -> list[pa.Array]:
        doc, partial, *one = (_list(table, c) for c in table.column_names[1:])
        order = _best(doc, partial, k_refine)
        return [pa.array(doc[order]), pa.array(np.arange(len(order), dtype=np.int32)), *(pa.array(x[order]) for x in one)]

    return _by_query(lists, pick, "prank int" + ", score double" * scored, query_kind, doc_kind)


def chosen(lists: DataFrame, k_refine: int, k_full_bit: int, num_chunks: int, query_kind: str = "int", doc_kind: str = "int") -> DataFrame:
    """query_id, doc_id of those of ``ranked`` that are to be rescored."""

    def pick(table: pa.Table) -> list[pa.Array]:
        doc, partial, one = (_list(table, c) for c in _KINDS)
        order = _best(doc, partial, k_refine)
        return [pa.array(doc[order][taken(one[order], k_full_bit, num_chunks)])]

    return _by_query(lists, pick, "", query_kind, doc_kind)


def refined_tokens(refined: DataFrame, tokens: DataFrame) -> DataFrame:
    """query_id, doc_id, token_id of all tokens of refined documents: a document is one row of
    its tokens' ids, which are a table to look refined pairs up in; these are many more and are
    not sorted."""
    docs = tokens.groupBy("doc_id").agg(F.collect_list("token_id").alias("ids"))
    met = refined.select("query_id", "doc_id").join(docs.hint("shuffle_hash"), "doc_id")
    return met.select("query_id", "doc_id", F.explode("ids").alias("token_id"))


# --- scores of chosen pairs -----------------------------------------------------------------


def _met(pairs: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Documents with the queries they are paired with, and ``columns``."""
    return pairs.groupBy("doc_id").agg(F.collect_list("query_id").alias("queries")).join(docs.select("doc_id", *columns), "doc_id").select("doc_id", "queries", *columns)


def _meetings(part: pa.RecordBatch, size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows (doc_id, queries, ...): each query, its documents' places and those of their tokens."""
    asked = part.column(1)
    query = asked.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), asked.value_lengths().to_numpy(zero_copy_only=False))
    order, start = np.argsort(query, kind="stable"), np.cumsum(size) - size
    query, row = query[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]]))
    for b, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = row[b:e]
        n = size[own]
        yield int(query[b]), own, np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def token_scores(pairs: DataFrame, docs: DataFrame, shared, dim: int) -> DataFrame:
    """query_id, token_id, q_pos, score: one-bit scores, without a floor, of all tokens of paired
    documents; ``docs`` has token_id, code1, f1, ``shared`` is a ``query_matrices``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = shared.value
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for b, e in _runs(sizes, TOKENS_AT_ONCE):
                part = batch.slice(b, e - b)
                token, f1 = (part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 4))
                words = part.column(3).flatten().flatten().to_numpy(zero_copy_only=False)
                bits = quantize.unpack_words(words.reshape(len(f1), -1), dim).astype(float)
                for q, _, at in _meetings(part, sizes[b:e]):
                    x, one, _ = matrices[q]
                    score = one_bit_scores(bits[at], f1[at], x, one)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(score.size, q, np.int64)), pa.array(np.repeat(token[at], len(x))), pa.array(np.tile(np.arange(len(x), dtype=np.int32), len(at))), pa.array(score.ravel())], names=["query_id", "token_id", "q_pos", "score"])

    flat = _met(pairs, docs, "token_id", "code1", "f1").mapInArrow(run, "query_id long, token_id long, q_pos int, score double")
    return flat.withColumn("query_id", F.col("query_id").cast(pairs.schema["query_id"].dataType))


def document_scores(pairs: DataFrame, docs: DataFrame, shared, dim: int, ex_bits: int) -> DataFrame:
    """query_id, doc_id, score: full-bit MaxSim of paired documents, whose codes are unpacked
    once for all queries; ``docs`` has code, fb, ``shared`` is a ``query_matrices``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = shared.value
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for b, e in _runs(sizes, TOKENS_AT_ONCE):
                part, size = batch.slice(b, e - b), sizes[b:e]
                doc, fb = part.column(0).to_numpy(zero_copy_only=False), part.column(3).flatten().to_numpy(zero_copy_only=False)
                code = quantize.unpack_codes(_bytes(part.column(2).flatten()).reshape(len(fb), -1), dim, ex_bits + 1).astype(float)
                found = []
                for q, own, at in _meetings(part, size):
                    x, _, full = matrices[q]
                    found.append((np.full(len(own), q, np.int64), doc[own], best_of((code[at] @ x.T - full[None, :]) * fb[at][:, None], size[own]).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "doc_id", "score"])

    flat = _met(pairs, docs, "code", "fb").mapInArrow(run, f"query_id long, doc_id {pairs.schema['doc_id'].dataType.simpleString()}, score double")
    return flat.withColumn("query_id", F.col("query_id").cast(pairs.schema["query_id"].dataType))
