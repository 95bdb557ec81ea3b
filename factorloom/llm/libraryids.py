"""Ids of the tokenizers library for whole texts, remembered unit by unit.

Units are cut where both kinds of vocabulary have a piece border (see ``textunits``), so the library
sees each distinct unit once per memo generation instead of at every place it stands.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

from factorloom.llm.bpe import byte_alphabet
from factorloom.llm.textunits import Memo, blank_cut, byte_level_pieces, library_pieces

UNIT_MEMO = 300_000
PIECE_MEMO = 300_000


class LibraryIds:
    """Encoder of a vocabulary file by the library; ids have two bytes if all fit, else four."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            described = json.load(file)
        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self._keeps_blanks = described["pre_tokenizer"]["type"] == "ByteLevel" and not described["normalizer"]
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        self._cut = library_pieces(self._tokenizer)
        if sys.byteorder != "little":
            raise RuntimeError("ids are packed in the machine's order, which must be little-endian")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._merge = self._tokenizer.model.tokenize
        self._blank = next(c for c, b in byte_alphabet().items() if b == 0x20)
        self._shown = {b: c for c, b in byte_alphabet().items()}
        self._piece = Memo(self._merged if self._keeps_blanks else self._word, PIECE_MEMO)
        self._unit = Memo(self._spaced_unit if self._keeps_blanks else self._word_unit, UNIT_MEMO)

    def _library(self, text: str) -> bytes:
        return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        """Ids of one piece: the library's merges alone, as its cutting is done."""
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self._blank)
        else:
            shown = piece.encode().decode("latin-1").translate(self._shown)
        return array(self._code, [t.id for t in self._merge(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word without blanks; plain letters need no cutting and only lower case."""
        if word.isascii() and word.isalpha():
            return array(self._code, [t.id for t in self._merge(word.lower())]).tobytes()
        return self._library(word)

    def _spaced_unit(self, unit: str) -> bytes:
        if unit.isascii():
            if unit.isalpha():
                return self._piece[" " + unit]
            if unit[:-1].isalpha() and unit[-1] in ".,":
                return self._piece[" " + unit[:-1]] + self._piece[unit[-1]]
        return b"".join([self._piece[p] for p in byte_level_pieces(" " + unit, self._cut)])

    def _word_unit(self, unit: str) -> bytes:
        if unit.isascii() and unit[-1] in ".,;:!?" and unit[:-1].isalpha():
            return self._piece[unit[:-1]] + self._piece[unit[-1]]
        return self._piece[unit]

    def _stretch(self, text: str) -> bytes:
        first, *rest = blank_cut(text)
        head = b"".join([self._piece[p] for p in byte_level_pieces(first, self._cut)]) if first else b""
        return head + b"".join(map(self._unit.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed in ``dtype``."""
        if not self._keeps_blanks:
            if any("\x1c" <= c <= "\x1f" for c in set(text)):
                return self._library(text)  # not white space to the vocabulary
            return b"".join(map(self._unit.__getitem__, text.split()))
        if not any(s in text for s in self._specials):
            return self._stretch(text)
        parts = []
        while True:
            hits = [(at, -len(s), s) for s in self._specials if (at := text.find(s)) >= 0]
            if not hits:
                return b"".join([*parts, self._stretch(text)])
            at, _, special = min(hits)
            parts += [self._stretch(text[:at]), self._specials[special].to_bytes(self.dtype.itemsize, "little")]
            text = text[at + len(special):]


_encoders: dict[str, LibraryIds] = {}


def library_ids(vocabulary: str) -> LibraryIds:
    """The encoder of a vocabulary file, one in each Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = LibraryIds(vocabulary)
    return _encoders[vocabulary]
