"""Ground truth from tab-separated text: query_id, document_id, rank, and more fields that are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str, depth: int = 1000, n_queries: int | None = None) -> DataFrame:
    """query_id, doc_id, rank (from 1).

    Lines of fewer than three fields are left out.  A rank outside 1..depth, a
    field that is no number, or a query_id outside 0..n_queries - 1 is an error.  Of
    lines for one (query, rank) the last wins.
    """
    field = F.split("value", "\t")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.size(field) >= 3)
    rows = lines.select(
        F.try_to_number(F.trim(field[0]), F.lit("999999999")).cast("int").alias("query_id"), F.try_to_number(F.trim(field[1]), F.lit("999999999999999999")).cast("long").alias("doc_id"), F.try_to_number(F.trim(field[2]), F.lit("999999999")).cast("int").alias("rank"), "line", "value"
    )
    bad = F.col("query_id").isNull() | F.col("doc_id").isNull() | F.col("rank").isNull() | ~F.col("rank").between(1, depth)
    if n_queries is not None:
        bad = bad | ~F.col("query_id").between(0, n_queries - 1)
    checked = rows.withColumn("rank", F.when(bad, F.raise_error(F.concat(F.lit("not a ground-truth line: "), F.col("value"))).cast("int")).otherwise(F.col("rank")))
    return checked.groupBy("query_id", "rank").agg(F.max_by("doc_id", "line").alias("doc_id")).select("query_id", "doc_id", "rank")


def write(truth: DataFrame, path: str) -> None:
    """truth (query_id, doc_id, rank) as a folder of text files."""
    truth.select(F.concat_ws("\t", "query_id", "doc_id", "rank").alias("value")).write.mode("overwrite").text(path)
