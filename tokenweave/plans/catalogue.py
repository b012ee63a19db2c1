"""Every query of the retrieval engine on the sample corpus."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import quantize
from ..index import MultiVectorIndex
from ..operators import build as B
from ..operators import capacity, evaluate
from ..operators import dense as D
from ..operators import search as S
from ..options import PADDED_DIM
from ..sources import ground_truth, mvbin
from .fixture import EX_BITS, LONGEST, Fixture, K, shared_folder
from .oracle import ORACLE_SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The same by corpus.
PLANS: dict[str, Callable[[Fixture], DataFrame]] = {}


def query(f: Callable[[Fixture], DataFrame]) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Fixture(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__], PLANS[f.__name__] = run, f
    return run


def per_token(f: Fixture, compute: Callable[[np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """token_id and what ``compute`` gives for the rotated vectors."""
    names = ["token_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *compute(B.vectors(batch.column(1)))], names=names)

    return f.rotated.mapInArrow(run, f"token_id long, {schema}")


def _joined(codes: np.ndarray) -> pa.Array:
    return pa.array([",".join(map(str, row)) for row in codes.tolist()])


# --- documents and build ------------------------------------------------------------------


@query
def token_doc_map(f):
    return B.token_doc_map(f.docs).select(F.col("token_id").cast("long").alias("token_id"), "doc_id")


@query
def doc_offsets(f):
    return f.docs.select("doc_id", "doc_len", F.col("start").alias("first_token"), F.col("end").alias("end_token"))


@query
def doc_len_stats(f):
    return B.input_stats(f.tokens, f.doc_lens)


@query
def centroid_sample(f):
    return f.centroids.select("cluster_id", "token_id")


@query
def assign_nearest(f):
    return f.assigned.select("token_id", "cluster_id")


@query
def ivf_postings(f):
    return B.postings(f.assigned).select(F.col("cluster_position").cast("long").alias("cluster_position"), "cluster_id", "token_id", "doc_id")


@query
def cluster_offsets(f):
    return B.cluster_offsets(f.assigned, f.build.n_clusters).select("cluster_id", "n", F.col("start").alias("first_position"))


@query
def cluster_stats_bounds(f):
    return capacity.cluster_bounds(f.assigned, f.options.nprobe)


@query
def refined_token_bound(f):
    return capacity.refined_token_bound(f.doc_lens, f.options.k_refine)


@query
def rotate_tokens(f):
    spread = f.rotated.select("token_id", F.posexplode("rotated").alias("dim", "value"))
    return spread.select("token_id", "dim", (F.round("value", 6) + 0.0).alias("value"))


# --- codes --------------------------------------------------------------------------------


@query
def onebit_codes(f):
    def words(x):
        return [pa.array(c) for c in quantize.pack_words(x > 0).view("<u4").astype(np.int64).T]

    return per_token(f, words, "w0 long, w1 long, w2 long, w3 long")


@query
def onebit_factor(f):
    return per_token(f, lambda x: [pa.array(quantize.one_bit(x)[1])], "f1 double").select("token_id", F.round("f1", 8).alias("f1"))


@query
def rescale_sweep(f):
    def sweep(x):
        return [pa.array(quantize.best_rescale(np.abs(x) / np.linalg.norm(x, axis=1, keepdims=True), EX_BITS))]

    return per_token(f, sweep, "t double").select("token_id", F.round("t", 6).alias("t"))


@query
def ex_codes(f):
    return per_token(f, lambda x: [_joined(quantize.ex_codes(x, EX_BITS))], "code string")


@query
def full_codes(f):
    """Through the packed bytes of the index and back."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _joined(quantize.unpack_codes(packed, PADDED_DIM, EX_BITS + 1))], names=["token_id", "code"])

    return f.encoded.select("token_id", "code").mapInArrow(unpack, "token_id long, code string")


@query
def full_factor(f):
    return f.encoded.select("token_id", F.round("fb", 9).alias("fb"))


# --- search -------------------------------------------------------------------------------


@query
def query_state(f):
    return f.states.select("query_id", "q_pos", F.round("cb1_sumq", 6).alias("cb1_sumq"), F.round("cbex_sumq", 6).alias("cbex_sumq"))


@query
def onebit_lut(f):
    return S.one_bit_lut(f.states).withColumn("value", F.round("value", 6) + 0.0)


@query
def probe_topn(f):
    return f.probes.withColumn("rank", F.col("rank").cast("int"))


@query
def candidate_docs(f):
    return S.candidate_docs(f.probes, f.postings)


@query
def candidate_counts(f):
    return S.candidate_docs(f.probes, f.postings).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query
def partial_scores(f):
    return f.partial.select("query_id", "doc_id", F.round("partial", 6).alias("score"))


@query
def refine_topk(f):
    return f.refined


@query
def refined_offsets(f):
    return S.refined_offsets(f.refined, f.docs).withColumnRenamed("offset", "first_place")


@query
def refined_tokens(f):
    return D.refined_tokens(f.refined, f.stored)


@query
def onebit_token_scores(f):
    return f.by_block(lambda block, shared: D.token_scores(f.refined.where(block), f.one_bit_docs, shared, PADDED_DIM)).select("query_id", "token_id", "q_pos", (F.round("score", 6) + 0.0).alias("score"))


@query
def onebit_doc_scores(f):
    return f.one_bit.withColumn("score", F.round("score", 6))


@query
def chunk_quota(f):
    return f.chosen


@query
def fullbit_scores(f):
    return f.full.withColumn("score", F.round("score", 6))


@query
def search_topk(f):
    """The flagship: an index is built, stored and searched."""
    return f.index().stored(shared_folder(f.spark)).search(f.queries, K).withColumn("score", F.round("score", 6))


# --- evaluation, sources and sinks --------------------------------------------------------


@query
def exact_maxsim_topk(f):
    return f.exact.withColumn("score", F.round("score", 6))


@query
def recall_at_k(f):
    return evaluate.recall_at_k(f.exact, S.top_k(f.full, K), K, f.n_queries).withColumn("recall", F.round("recall", 6))


@query
def latency_percentiles(f):
    values = f.spark.read.parquet(f"{f.sf_dir}/events.parquet")
    got = evaluate.latency_summary(values, "value")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query
def gt_tsv_parse(f):
    """Ground truth written as text and read back."""
    path = shared_folder(f.spark)
    ground_truth.write(f.exact, path)
    return ground_truth.read(f.spark, path, 1000, f.n_queries)


@query
def index_roundtrip(f):
    """An index saved twice to one folder, loaded and searched."""
    path = shared_folder(f.spark)
    for _ in range(2):
        f.index().save(path)
    return MultiVectorIndex.load(f.spark, path, f.options).search(f.queries, K).withColumn("score", F.round("score", 6))


@query
def mvbin_roundtrip(f):
    """Embeddings, document lengths and queries through the binary formats.  Queries of a file
    have one length, so a document's tokens follow each other in turn up to four."""
    base = shared_folder(f.spark).removeprefix("file://")
    os.makedirs(base, exist_ok=True)
    mvbin.write_embeddings(f.tokens, f"{base}/embeddings.bin")
    mvbin.write_doc_lens(f.doc_lens, f"{base}/doclens.bin")
    size = f.queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    turns = f.queries.join(size, "query_id").withColumn("q_pos", F.explode(F.sequence("q_pos", F.lit(LONGEST - 1), F.col("n").cast("int"))))
    mvbin.write_queries(turns, f"{base}/queries.bin")
    tokens = mvbin.read(f.spark, f"{base}/embeddings.bin", "embeddings", rows_per_partition=128)
    lens, asked = mvbin.read(f.spark, f"{base}/doclens.bin", "doclens"), mvbin.read(f.spark, f"{base}/queries.bin", "queries")
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 6) + 0.0
    return (
        tokens.select(F.lit("token").alias("kind"), F.col("token_id").alias("id"), F.lit(0).alias("place"), total("embedding").alias("value"))
        .unionByName(lens.select(F.lit("doc").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.lit(0).alias("place"), F.col("doc_len").cast("double").alias("value")))
        .unionByName(asked.select(F.lit("query").alias("kind"), F.col("query_id").cast("long").alias("id"), F.col("q_pos").alias("place"), total("embedding").alias("value")))
    )
