"""Operator 9: exact token totals for every context limit from a length histogram.

Documents are aggregated by encoded length; every later answer is a suffix sum
over the histogram, whose size is the number of distinct lengths whatever the
number of documents.

Defined results: null text is empty and has length 0; an empty table gives an
empty histogram; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import encoder
from .textops import chunks


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: n_tokens, without special tokens."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(0).fill_null("")
            for b, e in chunks(texts, 1_000_000):
                n = [len(c) // coder.dtype.itemsize for c in coder.encode(texts.slice(b, e - b).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(measure, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: the whole state of the operator."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, as a context limit L, one row:

    context_limit, n_docs (of that length), docs_whole (length <= L), docs_cut,
    tokens_kept = sum(min(length, L)), tokens_lost, tokens_total, share_whole
    (the quantile at which L stands).
    """
    suffix = Window.orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    prefix = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return histogram.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        F.sum("n_docs").over(prefix).alias("docs_whole"),
        F.coalesce(F.sum("n_docs").over(suffix), F.lit(0)).alias("docs_cut"),
        (F.sum(tokens).over(prefix) + F.col("n_tokens") * F.coalesce(F.sum("n_docs").over(suffix), F.lit(0))).alias("tokens_kept"),
        (F.coalesce(F.sum(tokens).over(suffix), F.lit(0)) - F.col("n_tokens") * F.coalesce(F.sum("n_docs").over(suffix), F.lit(0))).alias("tokens_lost"),
        F.sum(tokens).over(everything).alias("tokens_total"),
        (F.sum("n_docs").over(prefix) / F.sum("n_docs").over(everything)).alias("share_whole"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_cut, tokens_kept for any limits, occurring or not."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in sorted(set(limits))], "context_limit long")
    exploded = histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))])).alias("context_limit"))
    got = exploded.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
    )
    return asked.join(got, "context_limit", "left").na.fill(0)


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of documents does not exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    table = context_table(histogram).select("context_limit", "share_whole")
    return asked.join(table, F.col("share_whole") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
