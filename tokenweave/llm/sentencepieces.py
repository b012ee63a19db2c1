"""Operator 10: SentencePiece encoding and decoding.

One Aho-Corasick automaton holds all pieces.  A single pass over the text drives
a Viterbi search: at each position the automaton's output links list the pieces
that end there, and each relaxes the best score of its end from its start.  Ties
go to the longer last piece.  A character that is no piece is spelled in byte
pieces, each at a score below every piece's.

Where no piece of the vocabulary crosses the beginning of a word (checked when
it is loaded), words are searched one by one and remembered per worker.

Defined results: a text gets one space mark in front, as the models expect; null
and empty texts give no ids; decoding inverts encoding exactly, for any text.
Repeated rows are encoded alike; other columns are carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .pieces import SPACE, Vocabulary, vocabulary
from .textops import chunks

#: Bytes of words, with their ids, that a worker remembers; a word costs ``ENTRY_BYTES``
#: and six bytes a character.
CACHE_BYTES, ENTRY_BYTES = 100 << 20, 200
#: A stand-in for a literal space mark while marks stand for spaces; a
#: noncharacter, and itself spelled in bytes like any unknown character.
_LITERAL = "﷐"
_SPLIT = re.compile(f"{SPACE}*[^{SPACE}]*")


class PieceCoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._known: dict[str, bytes] = {}
        self._held = 0
        self._bytes = [p.encode() for p in (x.replace(SPACE, " ") for x in vocab.pieces)]
        for value, i in vocab.byte_ids.items():
            self._bytes[i] = bytes([value])
        self.dtype = np.dtype("<u2" if vocab.size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def viterbi(self, marked: str) -> list[int]:
        """Ids of the best segmentation of a string in which marks stand for spaces."""
        vocab, n = self.vocab, len(marked)
        scores, single = vocab.scores, vocab.single
        lowest = float("-inf")
        best, back = [lowest] * (n + 1), [(-1, -1)] * (n + 1)
        best[0] = 0.0
        for at, char in enumerate(marked):
            if char not in single:
                # Placed before the pieces that end here are relaxed; its start is settled only
                # when the search gets there, so remember it as a piece of length one.
                back[at + 1] = (1, -1)
        done = 0

        def close(upto: int) -> None:
            """Settle spelled characters up to a position; they relax from the left."""
            nonlocal done
            while done < upto:
                done += 1
                if back[done] == (1, -1):
                    best[done] = best[done - 1] + vocab.floor * len(marked[done - 1].encode())

        for last, (length, i) in vocab.automaton.iter(marked):
            end = last + 1
            close(end)
            score = best[end - length] + scores[i]
            if score > best[end] or (score == best[end] and length > back[end][0]):
                best[end], back[end] = score, (length, i)
        close(n)
        ids: list[int] = []
        while n > 0:
            length, i = back[n]
            ids += [i] if i >= 0 else vocab.fallback(SPACE if marked[n - 1] == _LITERAL else marked[n - 1])[::-1]
            n -= length
        return ids[::-1]

    def _word(self, marked: str) -> bytes:
        return np.array(self.viterbi(marked), self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian ids, ``dtype`` wide."""
        if not text:
            return b""
        known = self._known
        if SPACE in text or _LITERAL in text:
            # The stand-in may itself occur: then only the plain search is safe.
            if _LITERAL in text:
                return b"".join(self._spelled(x) for x in re.split(f"([{_LITERAL}{SPACE}])", " " + text))
            text = text.replace(SPACE, _LITERAL)
        if not self.vocab.by_word:
            return self._word(SPACE + text.replace(" ", SPACE))
        if self._held > CACHE_BYTES:
            known.clear()
            self._held = 0
        words = text.split(" ")
        if "" in words:
            words = [x for x in _SPLIT.findall(SPACE + text.replace(" ", SPACE)) if x]
        else:
            words = [SPACE + x for x in words]
        for x in set(words).difference(known):
            known[x] = self._word(x)
            self._held += ENTRY_BYTES + 6 * len(x)
        return b"".join(map(known.__getitem__, words))

    def _spelled(self, part: str) -> bytes:
        if part in (_LITERAL, SPACE):
            return np.array(self.vocab.fallback(part), self.dtype).tobytes()
        return self._word(part.replace(" ", SPACE)) if part else b""

    def decode(self, ids: bytes) -> str:
        """The text; inverts ``encode``."""
        return b"".join(map(self._bytes.__getitem__, memoryview(ids).cast(self.code))).decode(errors="replace")[1:]


@cache
def coder(path: str) -> PieceCoder:
    return PieceCoder(vocabulary(path))


def _ids_array(coded: list[bytes], dtype: np.dtype) -> pa.Array:
    offsets = np.zeros(len(coded) + 1, np.int32)
    np.cumsum([len(c) // dtype.itemsize for c in coded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype).astype(np.int32)))


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """``docs`` with a column of ids (array<int>) in place of or beside any of that name."""
    columns = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(columns).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(model)
        for batch in batches:
            texts = batch.column(columns.index(text)).fill_null("")
            for b, e in chunks(texts):
                coded = [use.encode(x) for x in texts.slice(b, e - b).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(b, e - b) for c in batch.columns), _ids_array(coded, use.dtype)], names=[*columns, out])

    return docs.select(columns).mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the text of a column of ids; null ids give null."""
    columns = [c for c in coded.columns if c != out]
    schema = T.StructType([*coded.select(columns).schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(model)
        for batch in batches:
            lists = batch.column(columns.index(ids))
            texts = [None if x is None else use.decode(np.asarray(x, use.dtype).tobytes()) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, out])

    return coded.select(columns).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), n_chars,
    decoded_crc32 and exact (the decoded ids are the text) of every document, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = coder(model)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for b, e in chunks(texts):
                rows = texts.slice(b, e - b).to_pylist()
                coded = [use.encode(x) for x in rows]
                back = [use.decode(c) for c in coded]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(b, e - b),
                        pa.array([len(c) // use.dtype.itemsize for c in coded], pa.int64()),
                        pa.array([zlib.crc32(np.frombuffer(c, use.dtype).astype("<u4").tobytes()) for c in coded], pa.int64()),
                        pa.array([len(x) for x in back], pa.int64()),
                        pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                        pa.array([x == y for x, y in zip(rows, back, strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "n_chars", "decoded_crc32", "exact"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, n_chars long, decoded_crc32 long, exact boolean")
