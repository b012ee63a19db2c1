"""The flat binary formats of embeddings, queries and document lengths.

All numbers are little-endian 32-bit:

* embeddings: N, D, then N * D floats;
* queries: Q, L, D, then Q * L * D floats;
* doclens: M, then M integers.

``spark.read.format("mvbin").option("kind", "embeddings").load(path)`` reads row
ranges in parallel; each task seeks to its range.  Counts must be positive and the
payload complete; bytes after it are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = {"embeddings": 2, "queries": 3, "doclens": 1}
SCHEMAS = {
    "embeddings": "token_id bigint, embedding array<float>",
    "queries": "query_id int, q_pos int, embedding array<float>",
    "doclens": "doc_id int, doc_len int",
}
ROWS_AT_ONCE = 4096


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at), system.get_file_info(at).size


def header(path: str, kind: str) -> tuple[int, ...]:
    """The validated counts at the front of a file."""
    n = HEADER[kind]
    f, size = _open(path)
    with f:
        raw = f.read(4 * n)
    if len(raw) < 4 * n:
        raise ValueError(f"{path}: the header is incomplete")
    counts = struct.unpack(f"<{n}i", raw)
    if min(counts) <= 0:
        raise ValueError(f"{path}: counts must be positive, not {counts}")
    items = int(np.prod([int(c) for c in counts], dtype=object))
    if items > (1 << 62) or size < 4 * (n + items):
        raise ValueError(f"{path}: the payload is incomplete")
    return counts


class _Rows(InputPartition):
    def __init__(self, begin: int, stop: int):
        self.begin, self.stop = begin, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, rows: int):
        self.path, self.kind, self.rows = path, kind, rows
        self.counts = header(path, kind)

    def partitions(self) -> list[_Rows]:
        total = self.counts[0] * (self.counts[1] if self.kind == "queries" else 1)
        return [_Rows(b, min(b + self.rows, total)) for b in range(0, total, self.rows)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        kind, width = self.kind, 1 if self.kind == "doclens" else self.counts[-1]
        f, _ = _open(self.path)
        with f:
            for b in range(partition.begin, partition.stop, ROWS_AT_ONCE):
                n = min(ROWS_AT_ONCE, partition.stop - b)
                f.seek(4 * (HEADER[kind] + b * width))
                raw = f.read(4 * n * width)
                if len(raw) < 4 * n * width:
                    raise ValueError(f"{self.path}: short read")
                number = np.arange(b, b + n)
                if kind == "doclens":
                    columns = [pa.array(number.astype(np.int32)), pa.array(np.frombuffer(raw, "<i4"))]
                else:
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.frombuffer(raw, "<f4")))
                    ids = [number] if kind == "embeddings" else [(number // self.counts[1]).astype(np.int32), (number % self.counts[1]).astype(np.int32)]
                    columns = [*map(pa.array, ids), rows]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMAS[kind].split(", ")])


class MvBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mvbin"

    def _kind(self) -> str:
        kind = self.options.get("kind", "embeddings")
        if kind not in HEADER:
            raise ValueError(f"kind must be one of {sorted(HEADER)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._kind(), int(self.options.get("rows_per_partition", 1 << 17)))


def read(spark: SparkSession, path: str, kind: str = "embeddings", **options) -> DataFrame:
    spark.dataSource.register(MvBin)
    reader = spark.read.format("mvbin").option("kind", kind)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def _write(path: str, counts: tuple[int, ...], parts: Iterator[np.ndarray]) -> None:
    if min(counts) <= 0:
        raise ValueError("there must be rows")
    with open(path, "wb") as f:
        f.write(struct.pack(f"<{len(counts)}i", *counts))
        for part in parts:
            f.write(part.tobytes())


def _streamed(df: DataFrame, column: str, kind: str) -> Iterator[np.ndarray]:
    """Values of ordered rows, a partition at a time."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield np.asarray(row[column], kind)


def write_embeddings(tokens: DataFrame, path: str) -> None:
    """tokens (token_id, embedding) as one file, in order of token_id."""
    size = tokens.selectExpr("count(1) AS n", "max(size(embedding)) AS d", "min(size(embedding)) AS e").head()
    if size["n"] and size["d"] != size["e"]:
        raise ValueError("embeddings differ in dimension")
    _write(path, (size["n"], size["d"] or 0), _streamed(tokens.orderBy("token_id").select("embedding"), "embedding", "<f4"))


def write_queries(queries: DataFrame, path: str) -> None:
    """queries (query_id, q_pos, embedding) as one file; all of one length."""
    size = queries.groupBy("query_id").count().selectExpr("count(1) AS q", "max(count) AS l", "min(count) AS m").head()
    dim = queries.selectExpr("max(size(embedding)) AS d").head()["d"]
    if size["q"] and size["l"] != size["m"]:
        raise ValueError("queries differ in length")
    _write(path, (size["q"], size["l"] or 0, dim or 0), _streamed(queries.orderBy("query_id", "q_pos").select("embedding"), "embedding", "<f4"))


def write_doc_lens(docs: DataFrame, path: str) -> None:
    """docs (doc_id, doc_len) as one file, in order of doc_id."""
    _write(path, (docs.count(),), _streamed(docs.orderBy("doc_id").select("doc_len"), "doc_len", "<i4"))
