"""Building an index: document model, centroids, assignment, codes and postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import quantize
from ..functions.prefix import numbered, running_sum
from ..functions.rotation import rotate
from ..options import PADDED_DIM, SEED, BuildOptions

#: Bytes of centroids in one broadcast; more are met block by block.
BROADCAST_BYTES = 128 << 20


def vectors(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A matrix as an Arrow list column."""
    flat = pa.array(np.ascontiguousarray(matrix).ravel())
    if kind is not None:
        flat = flat.cast(kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), flat)


# --- documents ----------------------------------------------------------------------------


def doc_offsets(doc_lens: DataFrame) -> DataFrame:
    """doc_id, doc_len, start, end of documents (doc_id, doc_len): a prefix sum."""
    summed = running_sum(doc_lens.select("doc_id", "doc_len"), "doc_id", F.col("doc_len"), "start")
    return summed.select("doc_id", "doc_len", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("doc_len")).cast("long").alias("end"))


def token_doc_map(docs: DataFrame) -> DataFrame:
    """token_id, doc_id, pos of documents (doc_id, start, end)."""
    # An empty range would count down in sequence(); documents have a token at least.
    return docs.where("end > start").select(F.explode(F.sequence("start", F.col("end") - 1)).alias("token_id"), "doc_id", "start").select("token_id", "doc_id", (F.col("token_id") - F.col("start")).cast("int").alias("pos"))


def input_stats(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: what validation looks at."""
    one = tokens.agg(F.count(F.lit(1)).alias("n_tokens"), F.min(F.size("embedding")).cast("int").alias("dim_least"), F.max(F.size("embedding")).cast("int").alias("dim_most"))
    two = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_len").alias("len_least"), F.max("doc_len").alias("len_most"), F.sum("doc_len").alias("len_total"))
    return one.crossJoin(two)  # one row by one row


def validate(tokens: DataFrame, docs: DataFrame, options: BuildOptions) -> dict:
    stats = input_stats(tokens, docs).head().asDict()
    options.check(stats["n_tokens"], stats["dim_least"] or 0, stats["dim_most"] or 0)
    if not stats["n_docs"]:
        raise ValueError("there are no documents")
    if stats["len_least"] is None or stats["len_least"] <= 0:
        raise ValueError("every document must have a token")
    if stats["len_total"] != stats["n_tokens"]:
        raise ValueError("document lengths do not add up to the number of embeddings")
    return stats


# --- centroids ----------------------------------------------------------------------------


def sample_key(seed: int) -> Column:
    """A pseudo-random order of token ids; without ties below 2**32."""
    return F.pmod(F.col("token_id").cast("decimal(38,0)") * F.lit(2654435761).cast("decimal(20,0)") + F.lit(seed * 40503), F.lit(1 << 32).cast("decimal(20,0)")).cast("long")


def sample_centroids(tokens: DataFrame, n_clusters: int, seed: int = SEED) -> DataFrame:
    """cluster_id, token_id, embedding: ``n_clusters`` tokens in a seeded order."""
    chosen = tokens.select("token_id", "embedding", sample_key(seed).alias("key")).orderBy("key", "token_id").limit(n_clusters)
    order = Window.orderBy("key", "token_id")  # over n_clusters rows
    return chosen.select((F.row_number().over(order) - 1).cast("int").alias("cluster_id"), "token_id", "embedding")


def centroid_blocks(centroids: DataFrame, column: str = "embedding", limit: int = BROADCAST_BYTES, width: int = PADDED_DIM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cluster ids, matrix) of blocks of at most ``limit`` bytes, in order of
    cluster_id, which counts from 0; vectors have at most ``width`` components."""
    rows, begin = max(1, limit // (8 * width)), 0
    while True:
        part = centroids.where((F.col("cluster_id") >= begin) & (F.col("cluster_id") < begin + rows)).select("cluster_id", column).toArrow().sort_by("cluster_id")
        if part.num_rows:
            yield part.column(0).to_numpy(), vectors(part.column(1))
        if part.num_rows < rows:
            return
        begin += rows


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Without the row's own norm, which no ranking needs; rounded so that ties
    are ties in any summation order."""
    return np.round((centroids * centroids).sum(axis=1)[None, :] - 2.0 * (x @ centroids.T), 9)


def _nearest(shared, first: bool, rows: int = 4096) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            for b in range(0, batch.num_rows, rows):
                part = batch.slice(b, rows)
                distance = squared_distances(vectors(part.column(2)), matrix)
                at = distance.argmin(axis=1)
                best, cluster = distance[np.arange(len(at)), at], ids[at].astype(np.int32)
                if not first:
                    old, owner = (part.column(k).to_numpy(zero_copy_only=False) for k in (4, 3))
                    better = best < old  # blocks come in order of cluster_id
                    best, cluster = np.where(better, best, old), np.where(better, cluster, owner)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(cluster.astype(np.int32)), pa.array(best)], names=["token_id", "doc_id", "embedding", "cluster_id", "distance"])

    return run


def assign_nearest(tokens: DataFrame, centroids: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Tokens with their nearest centroid (ties: the lowest cluster_id) and distance."""
    spark = tokens.sparkSession
    out, kind = tokens.select("token_id", "doc_id", "embedding"), tokens.schema["embedding"].dataType.simpleString()
    ids = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in ("token_id", "doc_id"))
    for k, block in enumerate(centroid_blocks(centroids, limit=limit)):
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(_nearest(shared, k == 0), f"{ids}, embedding {kind}, cluster_id int, distance double")
    return out


def rotated(df: DataFrame, padded: int, seed: int, keep: list[str], column: str = "embedding", out: str = "rotated") -> DataFrame:
    """``keep`` columns and the rotated vector (array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(rotate(vectors(batch.column(len(keep))), padded, seed))], names=[*keep, out])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, column).mapInArrow(run, f"{kinds}, {out} array<double>")


# --- codes ----------------------------------------------------------------------------------


def encode(assigned: DataFrame, options: BuildOptions) -> DataFrame:
    """token_id, doc_id, cluster_id, code1 (64-bit words), f1, code (packed bytes), fb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 2048):
                part = batch.slice(b, 2048)
                x = rotate(vectors(part.column(3)), options.padded_dim, options.seed)
                bits, f1 = quantize.one_bit(x)
                code, fb = quantize.full_codes(x, options.ex_bits)
                packed = quantize.pack_codes(code, options.ex_bits + 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists(quantize.pack_words(bits)), pa.array(f1), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(fb)], names=["token_id", "doc_id", "cluster_id", "code1", "f1", "code", "fb"])

    kinds = ", ".join(f"{c} {assigned.schema[c].dataType.simpleString()}" for c in ("token_id", "doc_id", "cluster_id"))
    return assigned.select("token_id", "doc_id", "cluster_id", "embedding").mapInArrow(run, f"{kinds}, code1 array<bigint>, f1 double, code binary, fb double")


def encode_one_bit(assigned: DataFrame, options: BuildOptions) -> DataFrame:
    """token_id, doc_id, cluster_id, code1, f1: ``encode`` without the full codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 2048):
                part = batch.slice(b, 2048)
                bits, f1 = quantize.one_bit(rotate(vectors(part.column(3)), options.padded_dim, options.seed))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists(quantize.pack_words(bits)), pa.array(f1)], names=["token_id", "doc_id", "cluster_id", "code1", "f1"])

    kinds = ", ".join(f"{c} {assigned.schema[c].dataType.simpleString()}" for c in ("token_id", "doc_id", "cluster_id"))
    return assigned.select("token_id", "doc_id", "cluster_id", "embedding").mapInArrow(run, f"{kinds}, code1 array<bigint>, f1 double")


def postings(encoded: DataFrame) -> DataFrame:
    """Tokens in order of (cluster_id, token_id) with that order's number."""
    return numbered(encoded, "cluster_id", [F.col("token_id")], "cluster_position")


def cluster_offsets(assigned: DataFrame, n_clusters: int) -> DataFrame:
    """cluster_id, n, start of every cluster, empty ones included."""
    spark = assigned.sparkSession
    counts = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(n_clusters).select(F.col("id").cast("int").alias("cluster_id")).join(counts, "cluster_id", "left").na.fill(0, ["n"])
    return running_sum(every, "cluster_id", F.col("n"), "start").select("cluster_id", "n", F.col("start").cast("long").alias("start"))


def document_codes(encoded: DataFrame) -> DataFrame:
    """One row per document: its tokens' codes in token order, end to end.

    A group is one document's tokens, so its size is the document's length.
    """
    rows = F.array_sort(F.collect_list(F.struct("token_id", "code1", "f1", "code", "fb")))
    packed = encoded.groupBy("doc_id").agg(rows.alias("t"))
    field = lambda name: F.transform("t", lambda x: x[name])
    return packed.select("doc_id", F.size("t").alias("doc_len"), F.flatten(field("code1")).alias("code1"), field("f1").alias("f1"), F.aggregate(field("code"), F.lit(b"").cast("binary"), lambda a, c: F.concat(a, c)).alias("code"), field("fb").alias("fb"))
