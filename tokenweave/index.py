"""The index: build, search, save and load."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import build as B
from .operators import search as S
from .options import PADDED_DIM, QUERY_TOKENS, SEED, BuildOptions, SearchOptions

FORMAT_VERSION = 1
TABLES = ("docs", "centroids", "postings", "doc_codes")
#: Queries searched in one plan; their rotated tokens are broadcast.
QUERY_BLOCK = 1024


def _postings(encoded: DataFrame) -> DataFrame:
    return B.postings(encoded).select("cluster_id", "cluster_position", "token_id", "doc_id", "code1", "f1")


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@dataclass
class MultiVectorIndex:
    docs: DataFrame
    centroids: DataFrame
    postings: DataFrame
    doc_codes: DataFrame
    meta: dict
    options: SearchOptions
    #: Tokens with their codes, of an index that was built here and not loaded.
    encoded: DataFrame | None = None

    @staticmethod
    def build(tokens: DataFrame, doc_lens: DataFrame, n_clusters: int, ex_bits: int, options: SearchOptions | None = None, padded_dim: int = PADDED_DIM, seed: int = SEED) -> MultiVectorIndex:
        """tokens (token_id, embedding), numbered in document order; doc_lens (doc_id, doc_len).

        Tables are plans until ``save`` runs them.  Searches before that encode the
        tokens anew; ``stored`` saves the index and gives the loaded one.
        """
        how = BuildOptions(n_clusters, ex_bits, padded_dim, seed)
        options = options or SearchOptions()
        stats = B.validate(tokens, doc_lens, how)
        docs = B.doc_offsets(doc_lens)
        owned = tokens.select("token_id", "embedding").join(B.token_doc_map(docs), "token_id")
        plain = B.sample_centroids(tokens, n_clusters, seed)
        centroids = B.rotated(plain, padded_dim, seed, ["cluster_id", "token_id"])
        encoded = B.encode(B.assign_nearest(owned, plain), how)
        meta = {"n": stats["n_tokens"], "d": stats["dim_most"], "padded_dim": padded_dim, "n_clusters": n_clusters, "ex_bits": ex_bits, "seed": seed, "format_version": FORMAT_VERSION}
        return MultiVectorIndex(docs, centroids, _postings(encoded), B.document_codes(encoded), meta, options, encoded)

    def search(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """query_id, rank, doc_id, score for queries (query_id, q_pos, embedding)."""
        if k <= 0:
            raise ValueError("k must be positive")
        o, m = self.options, self.meta
        o.check_clusters(m["n_clusters"])
        if o.cagra_itopk_size < o.nprobe:
            warnings.warn("cagra_itopk_size is below nprobe; probing is exact, so it has no effect", stacklevel=2)
        states = S.query_states(queries, m["padded_dim"], m["seed"], m["ex_bits"], m["d"])
        matrices = S.query_matrices(states, QUERY_BLOCK * QUERY_TOKENS)
        if matrices is not None:
            return self._search_block(states, matrices, k)
        out = None
        for block in S.query_blocks(queries.select("query_id").distinct().count(), QUERY_BLOCK):
            part = states.where(block)
            found = self._search_block(part, S.query_matrices(part), k)
            out = found if out is None else out.unionByName(found)
        return out

    def _search_block(self, states: DataFrame, matrices: dict, k: int) -> DataFrame:
        o, m = self.options, self.meta
        dim = m["padded_dim"]
        shared = states.sparkSession.sparkContext.broadcast(matrices)
        probes = S.probe(states, self.centroids, o.nprobe)
        partial = S.partial_scores(S.probed_tokens(probes, self.postings), shared, dim)
        refined = S.refine(partial, o.k_refine)
        one = S.document_scores(refined, self.doc_codes, shared, dim)
        chosen = S.chunk_quota(refined, one, o.k_full_bit, o.num_chunks)
        full = S.document_scores(chosen, self.doc_codes, shared, dim, m["ex_bits"])
        return S.top_k(full, k)

    def save(self, path: str) -> None:
        """Parquet tables and, last of all, meta: a folder without it is incomplete."""
        if not self.meta["n"]:
            raise ValueError("an empty index cannot be saved")
        spark = self.docs.sparkSession
        _remove(spark, f"{path}/meta")
        tables = {name: getattr(self, name) for name in TABLES}
        if self.encoded is not None:
            # Every token is encoded once; postings and document codes come from the files.
            self.encoded.write.mode("overwrite").parquet(f"{path}/encoded")
            encoded = spark.read.parquet(f"{path}/encoded")
            tables |= {"postings": _postings(encoded), "doc_codes": B.document_codes(encoded)}
        for name, table in tables.items():
            if name == "postings":
                table = table.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id", "token_id")
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        _remove(spark, f"{path}/encoded")
        spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    def stored(self, path: str) -> MultiVectorIndex:
        """Save the index and load it, so that searches read its tables."""
        self.save(path)
        return MultiVectorIndex.load(self.docs.sparkSession, path, self.options)

    @staticmethod
    def load(spark: SparkSession, path: str, options: SearchOptions | None = None, padded_dim: int | None = None) -> MultiVectorIndex:
        options = options or SearchOptions()
        meta = json.loads(spark.read.text(f"{path}/meta").head()["value"])
        if meta.get("format_version") != FORMAT_VERSION:
            raise ValueError("the index has another format version")
        BuildOptions(meta["n_clusters"], meta["ex_bits"], meta["padded_dim"], meta["seed"]).check(meta["n"], meta["d"], meta["d"])
        if padded_dim is not None and padded_dim != meta["padded_dim"]:
            raise ValueError("the index has another padded dimension")
        options.check_clusters(meta["n_clusters"])
        docs, centroids, posted, codes = (spark.read.parquet(f"{path}/{name}") for name in TABLES)
        if posted.count() != meta["n"] or centroids.count() != meta["n_clusters"]:
            raise ValueError("the index is incomplete")
        return MultiVectorIndex(docs, centroids, posted, codes, meta, options)
