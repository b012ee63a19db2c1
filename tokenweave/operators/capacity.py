"""Planning statistics: how much a search may touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sum_of_largest(df: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """One row: the sum of the n largest values."""
    return df.orderBy(F.desc(value)).limit(n).agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(out))


def cluster_bounds(assigned: DataFrame, nprobe: int) -> DataFrame:
    """One row: largest cluster, and bounds of tokens and documents that one query
    token can reach with ``nprobe`` probes."""
    per = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("doc_id").alias("docs"))
    largest = per.agg(F.coalesce(F.max("tokens"), F.lit(0)).cast("long").alias("max_cluster"))
    return largest.crossJoin(sum_of_largest(per, "tokens", nprobe, "token_bound")).crossJoin(sum_of_largest(per, "docs", nprobe, "doc_bound"))  # single rows


def refined_token_bound(docs: DataFrame, k_refine: int) -> DataFrame:
    """One row: tokens of the ``k_refine`` longest documents."""
    return sum_of_largest(docs, "doc_len", k_refine, "token_bound")
