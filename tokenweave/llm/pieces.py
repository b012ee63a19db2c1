"""Piece vocabularies of sentencepiece models and their Aho-Corasick automata."""

from __future__ import annotations

from functools import cache

import ahocorasick
import sentencepiece

SPACE = "▁"


class Vocabulary:
    """Ordinary pieces with their scores, and byte pieces as fallback.

    A literal U+2581 in a text is spelled in bytes, so that decoding gives the
    text back exactly.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.scores = [sp.get_score(i) for i in range(self.size)]
        self.unknown_id = sp.unk_id()
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.plain = plain
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.single = {self.pieces[i] for i in plain if len(self.pieces[i]) == 1}
        #: A space mark stands only at the front of a piece or in a piece of such
        #: marks, so no piece crosses the place where a word begins.
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in (self.pieces[i] for i in plain))
        self.floor = min(self.scores[i] for i in plain) - 10.0

    def fallback(self, char: str) -> list[int]:
        """Byte pieces of a character that is no piece; the unknown id where the model has none."""
        return [self.byte_ids.get(b, self.unknown_id) for b in char.encode()]


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)
