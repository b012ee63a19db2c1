"""Searching a stream of queries: each micro-batch is one search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..index import MultiVectorIndex


def search_stream(index: MultiVectorIndex, queries: DataFrame, path: str, checkpoint: str, k: int = 100, **trigger) -> StreamingQuery:
    """Write query_id, rank, doc_id, score of streamed queries (query_id, q_pos,
    embedding) to a folder per batch.  All tokens of a query must arrive in one batch.

    A batch that is run again overwrites its own folder, so results are exactly once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        index.search(batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
