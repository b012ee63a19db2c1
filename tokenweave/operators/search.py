"""Searching an index: probe, partial scores, one-bit MaxSim, full-bit MaxSim, top k.

All queries go through one plan.  Only rotated query tokens and centroids are
broadcast, both in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import quantize
from ..functions.rotation import rotate
from .build import BROADCAST_BYTES, centroid_blocks, lists, squared_distances, vectors

#: Query tokens of one query; the probed ones are bits of a long.
MOST_QUERY_TOKENS = 63


def query_states(queries: DataFrame, padded: int, seed: int, ex_bits: int, dim: int | None = None) -> DataFrame:
    """query_id, q_pos, rotated, cb1_sumq, cbex_sumq; ``dim`` is the dimension asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                plain = vectors(batch.column(2))
                if dim is not None and plain.shape[1] != dim:
                    raise ValueError(f"queries have {plain.shape[1]} dimensions, the index {dim}")
                x = rotate(plain, padded, seed)
                one, full = quantize.query_sums(x, ex_bits)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(x), pa.array(one), pa.array(full)], names=["query_id", "q_pos", "rotated", "cb1_sumq", "cbex_sumq"])

    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("query_id", "q_pos"))
    return queries.select("query_id", "q_pos", "embedding").mapInArrow(run, f"{kinds}, rotated array<double>, cb1_sumq double, cbex_sumq double")


def one_bit_lut(states: DataFrame) -> DataFrame:
    """query_id, q_pos, chunk, entry, value: subset sums of four components each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 256):
                part = batch.slice(b, 256)
                table = quantize.lookup_table(vectors(part.column(2)))
                n, chunks, entries = table.shape
                row = np.repeat(np.arange(n), chunks * entries)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(np.tile(np.repeat(np.arange(chunks, dtype=np.int32), entries), n)), pa.array(np.tile(np.arange(entries, dtype=np.int32), n * chunks)), pa.array(table.ravel())],
                    names=["query_id", "q_pos", "chunk", "entry", "value"],
                )

    kinds = ", ".join(f"{c} {states.schema[c].dataType.simpleString()}" for c in ("query_id", "q_pos"))
    return states.select("query_id", "q_pos", "rotated").mapInArrow(run, f"{kinds}, chunk int, entry int, value double")


def _probe_block(shared, nprobe: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        n = min(nprobe, len(ids))
        for batch in batches:
            for b in range(0, batch.num_rows, 1024):
                part = batch.slice(b, 1024)
                distance = squared_distances(vectors(part.column(2)), matrix)
                best = np.argsort(distance, axis=1, kind="stable")[:, :n]
                row = np.repeat(np.arange(len(best)), n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(ids[best].ravel().astype(np.int32)), pa.array(distance[row, best.ravel()])], names=["query_id", "q_pos", "cluster_id", "distance"])

    return run


def probe(states: DataFrame, centroids: DataFrame, nprobe: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, q_pos, cluster_id, rank (from 0): exact nearest centroids by
    (distance, cluster_id).  Each block of centroids gives its own nearest."""
    spark = states.sparkSession
    kinds = ", ".join(f"{c} {states.schema[c].dataType.simpleString()}" for c in ("query_id", "q_pos"))
    out = None
    for block in centroid_blocks(centroids, "rotated", limit):
        near = states.select("query_id", "q_pos", "rotated").mapInArrow(_probe_block(spark.sparkContext.broadcast(block), nprobe), f"{kinds}, cluster_id int, distance double")
        out = near if out is None else out.unionByName(near)
    order = Window.partitionBy("query_id", "q_pos").orderBy("distance", "cluster_id")
    return out.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < nprobe).select("query_id", "q_pos", "cluster_id", "rank")


def probed_tokens(probes: DataFrame, postings: DataFrame) -> DataFrame:
    """Tokens of probed clusters, once per query, with the query tokens that probed
    the cluster as bits of ``mask``."""
    masks = probes.groupBy("query_id", "cluster_id").agg(F.expr("bit_or(shiftleft(1L, q_pos))").alias("mask"))
    return masks.join(postings.select("cluster_id", "doc_id", "token_id", "code1", "f1"), "cluster_id")


def candidate_docs(probes: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id of all documents with a token in a probed cluster."""
    return probes.select("query_id", "cluster_id").distinct().join(postings.select("cluster_id", "doc_id").distinct(), "cluster_id").select("query_id", "doc_id").distinct()


def query_blocks(n: int, most: int) -> list[Column]:
    """Conditions that deal ``n`` queries out by a hash into blocks of about ``most``; no
    list of their ids is needed."""
    parts = max(1, -(-n // most))
    return [F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b for b in range(parts)]


def query_matrices(states: DataFrame, most: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """Rotated tokens and sums of a bounded block of queries; None if they have
    over ``most`` tokens together."""
    rows = (states if most is None else states.limit(most + 1)).toArrow()
    if most is not None and rows.num_rows > most:
        return None
    rows = rows.sort_by([("query_id", "ascending"), ("q_pos", "ascending")])
    ids, x = rows.column("query_id").to_numpy(), vectors(rows.column("rotated"))
    one, full = rows.column("cb1_sumq").to_numpy(), rows.column("cbex_sumq").to_numpy()
    place = rows.column("q_pos").to_numpy()
    if len(place) and place.max() >= MOST_QUERY_TOKENS:
        raise ValueError(f"queries of at most {MOST_QUERY_TOKENS} tokens are supported")
    return {int(q): (x[ids == q], one[ids == q], full[ids == q]) for q in np.unique(ids)}


def one_bit_scores(bits: np.ndarray, f1: np.ndarray, query: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(tokens, query tokens) estimates of inner products."""
    return (bits @ query.T - sums[None, :]) * f1[:, None]


def _partial(shared, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            query, mask, doc, f1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
            bits = quantize.unpack_words(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), dim).astype(float)
            for q in np.unique(query).tolist():
                at = np.flatnonzero(query == q)
                x, one, _ = matrices[q]
                score = np.maximum(one_bit_scores(bits[at], f1[at], x, one), 0.0)
                probed = ((mask[at][:, None] >> np.arange(len(x))) & 1).astype(bool)
                # Fold rows of one document first: max over its tokens, of probed pairs only.
                order = np.argsort(doc[at], kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(doc[at][order]) != 0]))
                best = np.maximum.reduceat(np.where(probed, score, -1.0)[order], heads)
                row, place = np.nonzero(best >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), q, query.dtype)), pa.array(doc[at][order][heads][row]), pa.array(place.astype(np.int32)), pa.array(best[row, place])], names=["query_id", "doc_id", "q_pos", "score"])

    return run


def partial_scores(tokens: DataFrame, shared, dim: int) -> DataFrame:
    """query_id, doc_id, partial of every candidate: per query token the best
    non-negative one-bit score among probed tokens, summed."""
    kinds = {c: tokens.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    rows = tokens.select("query_id", "mask", "doc_id", "code1", "f1").mapInArrow(_partial(shared, dim), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, q_pos int, score double")
    best = rows.groupBy("query_id", "doc_id", "q_pos").agg(F.max("score").alias("score"))
    return best.groupBy("query_id", "doc_id").agg(F.sum("score").alias("partial"))


def refine(partial: DataFrame, k_refine: int) -> DataFrame:
    """query_id, doc_id, prank (from 0): the best by (partial DESC, doc_id ASC)."""
    order = Window.partitionBy("query_id").orderBy(F.round("partial", 9).desc(), "doc_id")
    return partial.withColumn("prank", F.row_number().over(order) - 1).where(F.col("prank") < k_refine).select("query_id", "doc_id", "prank")


def refined_offsets(refined: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, prank, doc_id, doc_len, offset: where each document's tokens would
    start if a query's refined documents lay end to end."""
    before = Window.partitionBy("query_id").orderBy("prank").rowsBetween(Window.unboundedPreceding, -1)
    return refined.join(docs.select("doc_id", "doc_len"), "doc_id").withColumn("offset", F.coalesce(F.sum("doc_len").over(before), F.lit(0)).cast("long")).select("query_id", "prank", "doc_id", "doc_len", "offset")


def refined_tokens(refined: DataFrame, tokens: DataFrame) -> DataFrame:
    """query_id, doc_id, token_id of all tokens of refined documents."""
    return refined.select("query_id", "doc_id").join(tokens.select("doc_id", "token_id"), "doc_id").select("query_id", "doc_id", "token_id")


def token_scores(refined: DataFrame, encoded: DataFrame, shared, dim: int) -> DataFrame:
    """query_id, doc_id, token_id, q_pos, score: one-bit scores without a floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = shared.value
        for batch in batches:
            query, doc, token, f1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
            for q in np.unique(query).tolist():
                at = np.flatnonzero(query == q)
                bits = quantize.unpack_words(batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1), dim)
                x, one, _ = matrices[q]
                score = one_bit_scores(bits, f1[at], x, one)
                row = np.repeat(at, len(x))
                yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(doc[row]), pa.array(token[row]), pa.array(np.tile(np.arange(len(x), dtype=np.int32), len(at))), pa.array(score.ravel())], names=["query_id", "doc_id", "token_id", "q_pos", "score"])

    met = refined.select("query_id", "doc_id").join(encoded.select("doc_id", "token_id", "code1", "f1"), "doc_id").select("query_id", "doc_id", "token_id", "code1", "f1")
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id", "token_id"))
    return met.mapInArrow(run, f"{kinds}, q_pos int, score double")


#: Document tokens decoded and scored at a time.
TOKENS_AT_ONCE = 16_384


def _runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to ``most``, or single larger ones."""
    total, b = np.cumsum(size), 0
    while b < len(size):
        before = int(total[b - 1]) if b else 0
        e = max(b + 1, int(np.searchsorted(total, before + most, side="right")))
        yield b, e
        b = e


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column's values end to end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[int(offsets[0]) : int(offsets[-1])]


def _maxsim(shared, dim: int, ex_bits: int | None) -> Callable:
    """Score of whole documents; ``ex_bits`` None: by one-bit codes.  The documents of
    a query are decoded together and meet it in one product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = shared.value
        for batch in batches:
            query = batch.column(0).to_numpy(zero_copy_only=False)
            out = np.zeros(batch.num_rows)
            for q in np.unique(query).tolist():
                x, one, full = matrices[q]
                own = np.flatnonzero(query == q)
                size = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)[own]
                for b, e in _runs(size, TOKENS_AT_ONCE):
                    at = pa.array(own[b:e])
                    f = batch.column(3).take(at).flatten().to_numpy(zero_copy_only=False)
                    codes = batch.column(2).take(at)
                    if ex_bits is None:
                        words = codes.flatten().to_numpy(zero_copy_only=False)
                        score = one_bit_scores(quantize.unpack_words(words.reshape(len(f), -1), dim), f, x, one)
                    else:
                        code = quantize.unpack_codes(_bytes(codes).reshape(len(f), -1), dim, ex_bits + 1)
                        score = (code @ x.T - full[None, :]) * f[:, None]
                    heads = np.cumsum(size[b:e]) - size[b:e]
                    out[own[b:e]] = np.maximum.reduceat(score, heads).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["query_id", "doc_id", "score"])

    return run


def document_scores(chosen: DataFrame, doc_codes: DataFrame, shared, dim: int, ex_bits: int | None = None) -> DataFrame:
    """query_id, doc_id, score: sum over query tokens of the best token score."""
    code, factor = ("code1", "f1") if ex_bits is None else ("code", "fb")
    met = chosen.select("query_id", "doc_id").join(doc_codes.select("doc_id", code, factor), "doc_id").select("query_id", "doc_id", code, factor)
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id"))
    return met.mapInArrow(_maxsim(shared, dim, ex_bits), f"{kinds}, score double")


def chunk_quota(refined: DataFrame, one_bit: DataFrame, k_full_bit: int, num_chunks: int) -> DataFrame:
    """query_id, doc_id of documents to rescore.

    The refined order is cut into chunks; after chunk c the best
    ``T * (c + 1) div C`` by one-bit score among chunks 0..c are taken.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    ranked = refined.join(one_bit, ["query_id", "doc_id"]).withColumn("n", n)
    ranked = ranked.withColumn("top", F.least("n", F.lit(k_full_bit))).withColumn("chunks", F.least("n", F.lit(num_chunks)))
    ranked = ranked.withColumn("width", F.ceil(F.col("n") / F.col("chunks")))
    seen = ranked.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("prank") / F.col("width")), F.col("chunks") - 1)))
    order = Window.partitionBy("query_id", "chunk").orderBy(F.round("score", 9).desc(), "prank")
    taken = seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.floor(F.col("top") * (F.col("chunk") + 1) / F.col("chunks")))
    return taken.select("query_id", "doc_id").distinct()


def top_k(full: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), doc_id, score by (score DESC, doc_id DESC)."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.desc("doc_id"))
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def exact_maxsim(queries: DataFrame, tokens: DataFrame, k: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, doc_id, score by exact inner products over all documents.

    The query set meets all documents in blocks, one of which is on the driver at a time.  Documents
    come whole, so scores are summed and the best k of each query taken in every batch; only these
    are shuffled.
    """
    spark = queries.sparkSession
    docs = tokens.groupBy("doc_id").agg(F.collect_list("embedding").alias("embeddings"))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    out = docs.where("false").selectExpr("0L AS query_id", "doc_id", "0D AS score")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).head()
    for block in query_blocks(size["n"], max(1, limit // (8 * (size["dim"] or 1)))):
        asked = queries.where(block).orderBy("query_id", "q_pos").select("query_id", "embedding").toArrow()
        if not asked.num_rows:
            continue
        shared = spark.sparkContext.broadcast((asked.column(0).to_numpy(), vectors(asked.column(1))))
        out = out.unionByName(docs.mapInArrow(_exact(shared, k), f"query_id long, doc_id {kind}, score double"))
    return top_k(out.select(F.col("query_id").cast("int").alias("query_id"), "doc_id", "score"), k)


#: Scores of tokens and query tokens computed at a time.
CELLS = 1 << 22


def _exact(shared, k: int) -> Callable:
    """Rows (doc_id, embeddings) to the best ``k`` documents of each query in every batch, by
    (score DESC, doc_id DESC)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for b, e in _runs(sizes, max(1, CELLS // len(x))):
                part, size = batch.slice(b, e - b), sizes[b:e]
                doc = part.column(0).to_numpy(zero_copy_only=False)
                score = np.add.reduceat(best_of(vectors(part.column(1).flatten()) @ x.T, size), first, axis=1)
                down = np.argsort(-doc, kind="stable")
                doc, score = doc[down], score[down]
                best = np.argsort(-np.round(score, 9), axis=0, kind="stable")[:k]
                column = np.broadcast_to(np.arange(len(first)), best.shape)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first][column.ravel()].astype(np.int64)), pa.array(doc[best.ravel()]), pa.array(score[best, column].ravel())], names=["query_id", "doc_id", "score"])

    return run


def best_of(score: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The largest of each document's rows; ``size`` rows of a document follow each other."""
    start, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
    size, start = size[order], start[order]
    best = score[start]
    for k in range(1, int(size[0]) if len(size) else 0):
        longer = int(np.searchsorted(-size, -k))  # documents of more than k rows
        np.maximum(best[:longer], score[start[:longer] + k], out=best[:longer])
    out = np.empty_like(best)
    out[order] = best
    return out
