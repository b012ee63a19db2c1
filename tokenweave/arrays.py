"""The index for callers with NumPy arrays in place of tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .index import MultiVectorIndex
from .operators.build import lists
from .options import PADDED_DIM, SEED, SearchOptions


def _embeddings(x: np.ndarray) -> pa.Array:
    return lists(x, pa.float32())


def build(spark: SparkSession, embeddings: np.ndarray, doc_lens: np.ndarray, n_clusters: int, ex_bits: int, options: SearchOptions | None = None, padded_dim: int = PADDED_DIM, seed: int = SEED) -> MultiVectorIndex:
    """An index over (tokens, dimensions) embeddings, whose documents lie end to end
    with lengths ``doc_lens``; documents and tokens are numbered from 0."""
    x, n = np.asarray(embeddings), np.asarray(doc_lens)
    if x.ndim != 2 or n.ndim != 1:
        raise ValueError("embeddings must have two dimensions and doc_lens one")
    tokens = spark.createDataFrame(pa.table({"token_id": pa.array(np.arange(len(x), dtype=np.int64)), "embedding": _embeddings(x)}))
    lengths = spark.createDataFrame(pa.table({"doc_id": pa.array(np.arange(len(n), dtype=np.int32)), "doc_len": pa.array(n.astype(np.int32))}))
    return MultiVectorIndex.build(tokens, lengths, n_clusters, ex_bits, options, padded_dim, seed)


def query_table(spark: SparkSession, queries: np.ndarray) -> DataFrame:
    """query_id, q_pos, embedding of queries (queries, tokens, dimensions)."""
    count, length, _ = queries.shape
    ids, places = np.divmod(np.arange(count * length, dtype=np.int32), max(length, 1))
    return spark.createDataFrame(pa.table({"query_id": pa.array(ids.astype(np.int32)), "q_pos": pa.array(places.astype(np.int32)), "embedding": _embeddings(queries.reshape(count * length, -1))}))


def search(index: MultiVectorIndex, queries: np.ndarray, k: int = 100) -> list[int] | list[list[int]]:
    """Document ids, best first: a list for one query (tokens, dimensions), a list of
    lists for queries (queries, tokens, dimensions)."""
    x = np.asarray(queries)
    if x.ndim not in (2, 3):
        raise ValueError("queries must have two or three dimensions")
    several = x if x.ndim == 3 else x[None]
    out: list[list[int]] = [[] for _ in range(len(several))]
    if len(several):
        found = index.search(query_table(index.docs.sparkSession, several), k)
        for row in found.select("query_id", "rank", F.col("doc_id").cast("long").alias("doc_id")).orderBy("query_id", "rank").collect():  # at most k rows a query
            out[row["query_id"]].append(row["doc_id"])
    return out if x.ndim == 3 else out[0]
