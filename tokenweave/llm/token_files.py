"""Operator 1: token ids as flat unsigned-integer files with document offsets.

Layout of a written folder, per part ``NNNNNN-<attempt>``:

* ``.bin`` token ids, little-endian unsigned, 2 bytes where the vocabulary has at
  most 65,536 entries and else 4; the documents' ids lie end to end;
* ``.idx`` ``n_docs + 1`` little-endian 64-bit offsets in tokens, from 0;
* ``.doc`` ``n_docs`` little-endian 64-bit document ids.

``manifest.json`` lists the parts in document order with the base of each: the
number of tokens before it, a prefix sum over the parts.  A task writes under a
name of its own attempt and only reported attempts enter the manifest, so a task
that ran twice leaves at most an orphan file.

Defined results: null text is empty (its ids are the end id alone); rows with
one doc_id stay adjacent, in order of their text; a null doc_id sorts first and
is stored as the lowest 64-bit value; an empty table gives a manifest without
parts; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import encoder
from .textops import chunks

NO_ID = -(1 << 63)
#: Texts of at most so many bytes are encoded together.
ENCODE_BYTES = 1_000_000


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class TokenFiles:
    """Handle of a written folder."""

    path: str
    dtype: str
    parts: tuple[dict, ...]

    @staticmethod
    def open(path: str) -> TokenFiles:
        system, root = _filesystem(path)
        with system.open_input_stream(f"{root}/manifest.json") as f:
            got = json.loads(f.read())
        return TokenFiles(path, got["dtype"], tuple(got["parts"]))

    def read(self, spark: SparkSession) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
        rows = [(p["name"], p["base"]) for p in self.parts]
        parts = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)), "name")
        path, dtype = self.path, self.dtype

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, base in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                    yield from _digest(path, dtype, name, base)

        return parts.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def documents(self, part: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of a part, as views of the mapped file."""
        tokens, offsets, ids = _open_part(self.path, self.dtype, self.parts[part]["name"])
        for k, d in enumerate(ids.tolist()):
            yield (None if d == NO_ID else d), tokens[offsets[k] : offsets[k + 1]]


def _mapped(path: str) -> pa.Buffer:
    system, at = _filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(at) as f:
            return f.read_buffer()
    with system.open_input_file(at) as f:
        return f.read_buffer()


def _open_part(path: str, dtype: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(_mapped(f"{path}/{name}.doc"), "<i8")
    offsets = np.frombuffer(_mapped(f"{path}/{name}.idx"), "<i8")
    tokens = np.frombuffer(_mapped(f"{path}/{name}.bin"), dtype) if offsets[-1] else np.zeros(0, dtype)
    return tokens, offsets, ids


def _digest(path: str, dtype: str, name: str, base: int, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    tokens, offsets, ids = _open_part(path, dtype, name)
    for b in range(0, len(ids), rows):
        e = min(b + rows, len(ids))
        crc = [zlib.crc32(tokens[offsets[k] : offsets[k + 1]].astype("<u4").tobytes()) for k in range(b, e)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[b:e], mask=ids[b:e] == NO_ID), pa.array(base + offsets[b:e]), pa.array(np.diff(offsets[b : e + 1])), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order.

    One shuffle, of the texts, by ranges of doc_id.  The driver receives one row
    per part.
    """
    spark = docs.sparkSession
    system, root = _filesystem(path)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], coder.dtype).tobytes()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        system, root = _filesystem(path)
        ids, lengths, out = [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(f"{root}/{name}.bin")
            ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
            texts = batch.column(1).fill_null("")
            for b, e in chunks(texts, ENCODE_BYTES):
                coded = coder.encode(texts.slice(b, e - b).to_pylist())
                lengths.append(np.array([len(c) // coder.dtype.itemsize + 1 for c in coded], np.int64))
                for c in coded:
                    out.write(c)
                    out.write(end)
        if out is None:
            return
        out.close()
        n = np.concatenate(lengths)
        offsets = np.zeros(len(n) + 1, "<i8")
        np.cumsum(n, out=offsets[1:])
        for suffix, value in (("idx", offsets), ("doc", np.concatenate(ids).astype("<i8"))):
            with system.open_output_stream(f"{root}/{name}.{suffix}") as f:
                f.write(value.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(n)], "tokens": [int(offsets[-1])]})

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    done = sorted(ordered.mapInArrow(write, "part long, name string, docs long, tokens long").collect())
    parts, base = [], 0
    for row in done:
        parts.append({"name": row["name"], "docs": row["docs"], "tokens": row["tokens"], "base": base})
        base += row["tokens"]
    files = TokenFiles(path, encoder(tokenizer).dtype.str, tuple(parts))
    with system.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": files.dtype, "end_id": end_id, "tokens": base, "parts": parts}).encode())
    return files
