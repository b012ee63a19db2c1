"""Recall, latency statistics and the evaluation loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LATENCY_SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def recall_at_k(truth: DataFrame, results: DataFrame, k: int, n_queries: int) -> DataFrame:
    """One row (k, recall): ground-truth rows (query_id, doc_id, rank) of rank up to
    k that are among the first k results, over n_queries * k."""
    if k <= 0 or n_queries <= 0:
        return truth.sparkSession.createDataFrame([(k, 0.0)], "k int, recall double")
    found = truth.where(F.col("rank") <= k).select("query_id", "doc_id").join(results.where(F.col("rank") <= k).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return found.agg(F.lit(k).alias("k"), (F.count(F.lit(1)) / F.lit(n_queries * k)).alias("recall"))


def latency_summary(values: DataFrame, column: str) -> DataFrame:
    """One row: mean, min, p50, p90, p95, p99, max and population stddev; zeros if empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shares = [zero(F.percentile(F.col(column), F.lit(q))).alias(name) for name, q in LATENCY_SHARES.items()]
    return values.agg(zero(F.avg(column)).alias("mean"), zero(F.min(column)).alias("min"), *shares, zero(F.max(column)).alias("max"), zero(F.stddev_pop(column)).alias("stddev"))


def evaluate(index, queries: DataFrame, truth: DataFrame, k: int = 100, nq: int = -1, warmup: int = 5) -> tuple[DataFrame, DataFrame]:
    """(recalls, latency): queries one by one, as a client would send them, after warm-up."""
    import time

    spark: SparkSession = queries.sparkSession
    ids = [r["query_id"] for r in queries.select("query_id").distinct().orderBy("query_id").collect()]
    ids = ids if nq < 0 else ids[:nq]
    if not ids:
        raise ValueError("there are no queries")
    one = lambda q: queries.where(F.col("query_id") == q)
    for q in ids[: min(warmup, len(ids))]:
        index.search(one(q), k).collect()
    rows, times = [], []
    for q in ids:
        began = time.perf_counter()
        rows += index.search(one(q), k).collect()
        times.append(((time.perf_counter() - began) * 1000,))
    got = spark.createDataFrame([(int(r["query_id"]), int(r["rank"]), int(r["doc_id"])) for r in rows], "query_id int, rank int, doc_id int")
    recalls = recall_at_k(truth, got, k, len(ids))
    if k == 100:
        recalls = recalls.unionByName(recall_at_k(truth, got, 10, len(ids)))
    return recalls, latency_summary(spark.createDataFrame(times, "ms double"), "ms")
