"""Byte-level BPE through the ``tokenizers`` library, one call per distinct piece of text.

The pre-tokenizer of a byte-level BPE never lets a token run across a space that
has a non-space character on both sides, and what it does on either side of such
a space does not depend on the other side.  So a text is cut there, every
distinct cut piece is encoded once per worker by the library, and the ids are
joined.  A text in which a space touches other white space is encoded whole.

A piece of Latin letters is one pre-token for sure, as is a full stop or comma
after it; those go straight to the library's BPE model.

The library reads the string of an added token (such as an end mark) in a text as
that token, wherever it stands.  A text that holds one is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np

#: Bytes of pieces, with their ids, that a worker remembers; a piece costs ``ENTRY_BYTES``
#: and four bytes a character.
CACHE_BYTES, ENTRY_BYTES = 200 << 20, 200


_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    bytes for themselves, the others in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class BpeEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.added = [t.content for _, t in added]
        # One of the special tokens marks the ends of pieces in a joint call.
        self.mark, self.mark_id = next(((t.content, i) for i, t in added if t.special), (None, None))
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._stops = {x: self._raw([x])[0] for x in ".,"}
        self._alphabet = _byte_alphabet()
        self._inner: dict[str, bytes | None] = {}
        self._first: dict[str, bytes] = {}
        self._held = 0

    def _raw(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def _raw_pieces(self, pieces: list[str], at_once: int = 64) -> list[bytes]:
        """As ``_raw``, of pieces without added tokens; many short ones cost one
        call, with the mark between them."""
        if self.mark is None:
            return self._raw(pieces)
        out, width = [], self.dtype.itemsize
        for b in range(0, len(pieces), at_once):
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(pieces[b : b + at_once])], add_special_tokens=False)[0].ids, self.dtype)
            cut, raw = (np.flatnonzero(ids == self.mark_id) * width).tolist(), ids.tobytes()
            out += [raw[x:y] for x, y in zip([0, *(c + width for c in cut)], [*cut, len(raw)], strict=True)]
        return out

    def _word(self, piece: str) -> bytes:
        """A space and a piece of letters: one pre-token."""
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._alphabet)
        return array(self._code, [t.id for t in self.model.tokenize(self._alphabet[32] + mapped)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, ``dtype`` wide."""
        marked = {k for k, t in enumerate(texts) if any(x in t for x in self.added)}
        if marked:
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in marked]))
            return [self._raw([t])[0] if k in marked else next(rest) for k, t in enumerate(texts)]
        if self._held > CACHE_BYTES:
            self._inner, self._first, self._held = {}, {}, 0
        inner, split = self._inner, [t.split(" ") for t in texts]
        new = [x for x in set().union(*split) if x not in inner]
        fine = []
        for piece in new:
            if _LETTERS(piece):
                if piece not in inner:
                    inner[piece] = self._word(piece)
            elif piece[-1:] in self._stops and _LETTERS(word := piece[:-1]):
                if word not in inner:
                    inner[word] = self._word(word)
                inner[piece] = inner[word] + self._stops[piece[-1]]
            elif piece and not piece[0].isspace() and not piece[-1].isspace():
                fine.append(piece)
            else:
                inner[piece] = None
        inner.update(zip(fine, self._raw_pieces([" " + x for x in fine]), strict=True))
        heads = list({s[0] for s in split} - self._first.keys())
        self._first.update(zip(heads, self._raw(heads), strict=True))
        self._held += ENTRY_BYTES * (len(new) + len(heads)) + 4 * (sum(map(len, new)) + sum(map(len, heads)))
        out = []
        for text, pieces in zip(texts, split, strict=True):
            head, pieces[0] = self._first[pieces[0]], ""
            try:
                out.append(head + b"".join(map(inner.__getitem__, pieces[1:])))
            except TypeError:  # a piece begins or ends in white space
                out.append(self._raw([text])[0])
        return out


@cache
def encoder(path: str) -> BpeEncoder:
    """One encoder per worker process and file."""
    return BpeEncoder(path)
