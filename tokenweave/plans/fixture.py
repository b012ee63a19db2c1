"""The sample corpus: token embeddings, documents and queries from table ``embeddings``.

Tokens are numbered by (label, vec_id); documents have lengths 3, 2, 4 in turn.  Every
document whose id is divisible by 50 is a query with all its tokens, so queries grow with the
table, as do clusters, probes and documents to rescore.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.prefix import numbered
from ..index import QUERY_BLOCK, MultiVectorIndex
from ..operators import build as B
from ..operators import dense as D
from ..operators import search as S
from ..options import PADDED_DIM, SEED, BuildOptions, SearchOptions, clusters_for, options_for

K = 10
EX_BITS = 4
#: Documents whose id is a multiple are queries; they have at most LONGEST tokens.
EVERY, LONGEST = 50, 4


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.gettempdir()).rstrip('/')}/tokenweave-{uuid.uuid4().hex}"


@dataclass
class Fixture:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def numbered(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/embeddings.parquet")
        return numbered(rows, "label", [F.col("vec_id")], "token_id").withColumn("token_id", F.col("token_id").cast("long"))

    @cached_property
    def tokens(self) -> DataFrame:
        r = F.col("token_id") % 9
        doc = (F.floor(F.col("token_id") / 9) * 3 + F.when(r < 3, 0).when(r < 5, 1).otherwise(2)).cast("int")
        return self.numbered.select("token_id", doc.alias("doc_id"), "embedding")

    @cached_property
    def doc_lens(self) -> DataFrame:
        return self.tokens.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("doc_len"))

    @cached_property
    def docs(self) -> DataFrame:
        return B.doc_offsets(self.doc_lens)

    @cached_property
    def stored(self) -> DataFrame:
        """``tokens``, written once: a search reads them several times and would number
        the table anew each time."""
        path = shared_folder(self.spark)
        if not self.spark.conf.get("spark.checkpoint.dir", None):
            atexit.register(shutil.rmtree, path, True)
        self.tokens.write.parquet(path)
        return self.spark.read.schema(self.tokens.schema).parquet(path)

    @cached_property
    def sizes(self) -> tuple[int, int]:
        """Numbers of tokens and documents, whose ids have no gaps."""
        return tuple(self.stored.agg(F.count(F.lit(1)), F.coalesce(F.max("doc_id") + 1, F.lit(0))).head())

    @property
    def n_docs(self) -> int:
        return self.sizes[1]

    @property
    def n_tokens(self) -> int:
        return self.sizes[0]

    @property
    def parts(self) -> int:
        """Partitions of documents that meet all queries."""
        return max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n_tokens // 4096)))

    @cached_property
    def build(self) -> BuildOptions:
        return BuildOptions(clusters_for(self.n_tokens), EX_BITS)

    @cached_property
    def options(self) -> SearchOptions:
        return options_for(self.build.n_clusters, self.n_docs)

    @property
    def n_queries(self) -> int:
        return -(-self.n_docs // EVERY)

    @cached_property
    def queries(self) -> DataFrame:
        r = F.col("token_id") % 9
        place = (r - F.when(r < 3, 0).when(r < 5, 3).otherwise(5)).cast("int")
        query = F.floor(F.col("doc_id") / EVERY).cast("int")
        return self.stored.where(F.col("doc_id") % EVERY == 0).select(query.alias("query_id"), place.alias("q_pos"), "embedding")

    @cached_property
    def centroids(self) -> DataFrame:
        return B.sample_centroids(self.stored, self.build.n_clusters)

    @cached_property
    def assigned(self) -> DataFrame:
        return B.assign_nearest(self.stored, self.centroids)

    @cached_property
    def rotated(self) -> DataFrame:
        return B.rotated(self.tokens, PADDED_DIM, SEED, ["token_id"])

    @cached_property
    def encoded(self) -> DataFrame:
        return B.encode(self.assigned, self.build)

    @cached_property
    def postings(self) -> DataFrame:
        return B.postings(self.encoded)

    @cached_property
    def states(self) -> DataFrame:
        return S.query_states(self.queries, PADDED_DIM, SEED, EX_BITS)

    @cached_property
    def blocks(self) -> list[tuple[Column, dict, Broadcast]]:
        """Blocks of queries with their matrices, also as a broadcast.  What a block probes
        is a byte for each query token and cluster and stays bounded too."""
        most = min(QUERY_BLOCK, max(1, B.BROADCAST_BYTES // (LONGEST * self.build.n_clusters)))
        blocks = [(block, S.query_matrices(self.states.where(block))) for block in S.query_blocks(self.n_queries, most)]
        return [(block, own, self.spark.sparkContext.broadcast(own)) for block, own in blocks if own]

    def by_block(self, step: Callable[[Column, Broadcast], DataFrame]) -> DataFrame:
        """``step`` over blocks of queries, each with its own broadcast."""
        return reduce(DataFrame.unionByName, (step(block, shared) for block, _, shared in self.blocks))

    @cached_property
    def rotated_centroids(self) -> DataFrame:
        return B.rotated(self.centroids, PADDED_DIM, SEED, ["cluster_id"])

    @cached_property
    def probes(self) -> DataFrame:
        return S.probe(self.states, self.rotated_centroids, self.options.nprobe)

    @cached_property
    def one_bit_docs(self) -> DataFrame:
        return D.documents(B.encode_one_bit(self.assigned, self.build), "token_id", "cluster_id", "code1", "f1", parts=self.parts)

    def lists(self, with_one: bool) -> DataFrame:
        """Packed lists of all candidates with their scores."""

        def step(block: Column, own: dict) -> DataFrame:
            asked = D.asked(own, self.states.where(block), self.rotated_centroids, self.build.n_clusters, self.options.nprobe)
            return D.candidates(self.one_bit_docs, self.spark.sparkContext.broadcast(asked), PADDED_DIM, with_one)

        return reduce(DataFrame.unionByName, (step(block, own) for block, own, _ in self.blocks))

    @cached_property
    def candidates(self) -> DataFrame:
        return self.lists(False)

    @cached_property
    def scored(self) -> DataFrame:
        """``candidates`` with one-bit scores, which ranking alone does not need."""
        return self.lists(True)

    @cached_property
    def partial(self) -> DataFrame:
        return D.partial_scores(self.candidates)

    @cached_property
    def refined(self) -> DataFrame:
        return D.ranked(self.candidates, self.options.k_refine)

    @cached_property
    def one_bit(self) -> DataFrame:
        return D.ranked(self.scored, self.options.k_refine).select("query_id", "doc_id", "score")

    @cached_property
    def chosen(self) -> DataFrame:
        o = self.options
        return D.chosen(self.scored, o.k_refine, o.k_full_bit, o.num_chunks)

    @cached_property
    def full(self) -> DataFrame:
        docs = D.documents(self.encoded, "code", "fb", parts=self.parts)
        return self.by_block(lambda block, shared: D.document_scores(self.chosen.where(block), docs, shared, PADDED_DIM, EX_BITS))

    @cached_property
    def exact(self) -> DataFrame:
        return S.exact_maxsim(self.queries, self.tokens, K)

    def index(self) -> MultiVectorIndex:
        return MultiVectorIndex.build(self.tokens.select("token_id", "embedding"), self.doc_lens, self.build.n_clusters, EX_BITS, self.options)
