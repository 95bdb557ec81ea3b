"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece one token is the last one of that prefix's encoding.  An automaton over
the vocabulary, whose suffix links lead from each match to the next shorter one, lists the tokens
that end at a position; the one that is compatible with the last token of the prefix before it is
stored, and following the stored tokens back from the end gives the ids.  Two tokens are compatible
if undoing their merges, latest first, never meets a merge across their border that would have come
earlier.

Null and empty texts have no ids and decode to the empty text.  Repeated rows and null ids are kept.
The strings of special tokens inside a text become their special ids, as the library does.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from factorloom.llm.textunits import (
    Memo, blank_cut, bounded_batches, byte_level_pieces, id_type, library_pieces, text_rows, texts_of,
)

UNIT_MEMO = 150_000
PIECE_MEMO = 200_000
PAIR_MEMO = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, back to its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixEncoder:
    """Encoder of one byte-level vocabulary file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            described = json.load(file)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        ids = described["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for token, number in ids.items():
            self.bytes_of[number] = as_bytes(token)
        for content, number in self.specials.items():
            self.bytes_of[number] = content.encode()
        self._size = size
        self._made_at = [-1] * size  # position of the merge that makes a token; bytes have none
        self._left, self._right = [0] * size, [0] * size
        self._merge_at = {}
        for at, merge in enumerate(described["model"]["merges"]):
            first, second = merge if isinstance(merge, list) else merge.split(" ")
            left, right, made = ids[first], ids[second], ids[first + second]
            self._merge_at[left * size + right] = at
            if self._made_at[made] < 0:
                self._made_at[made], self._left[made], self._right[made] = at, left, right
        self._suffixes = ahocorasick.Automaton()
        for number in ids.values():
            if self._is_own_encoding(number):
                word = self.bytes_of[number]
                self._suffixes.add_word(word.decode("latin-1"), (number, len(word)))
        self._suffixes.make_automaton()
        self._fits = {}
        self._library_cut = library_pieces(Tokenizer.from_file(vocabulary))
        self.piece = Memo(self._encode_piece, PIECE_MEMO)
        self.unit = Memo(self._encode_unit, UNIT_MEMO)

    def _clear_border(self, first: int, second: int, before: float) -> bool:
        """Whether no merge across the border of two tokens comes before theirs; ``before`` is exclusive."""
        made_at, merge_at, size = self._made_at, self._merge_at, self._size
        while True:
            crossing = merge_at.get(first * size + second)
            if crossing is not None and crossing < before:
                return False
            if made_at[first] > made_at[second]:
                before = made_at[first]  # an equal merge further left comes first
                first = self._right[first]
            elif made_at[second] >= 0:
                before = made_at[second] + 1
                second = self._left[second]
            else:
                return True

    def _is_own_encoding(self, token: int) -> bool:
        at = self._made_at[token]
        return at < 0 or self._clear_border(self._left[token], self._right[token], at)

    def prefix_tokens(self, piece: bytes) -> list[int]:
        """For every prefix length of a piece, the last token of that prefix's encoding (-1 for none)."""
        last = [-1] * (len(piece) + 1)
        fits, size = self._fits, self._size
        for end, (token, length) in self._suffixes.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before * size + token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= PAIR_MEMO:
                        fits.clear()
                    fit = fits[pair] = self._clear_border(before, token, float("inf"))
                if not fit:
                    continue
            last[end] = token
        return last

    def piece_ids(self, piece: bytes) -> list[int]:
        last, ids, end = self.prefix_tokens(piece), [], len(piece)
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        ids.reverse()
        return ids

    def pieces(self, unit: str) -> list[str]:
        return byte_level_pieces(unit, self._library_cut)

    def _encode_piece(self, piece: str) -> bytes:
        return np.array(self.piece_ids(piece.encode()), dtype="<u4").tobytes()

    def _encode_unit(self, unit: str) -> bytes:
        """Ids of a unit and of the blank before it."""
        if unit.isascii() and unit.isalpha():
            return self.piece[" " + unit]
        return b"".join([self.piece[p] for p in self.pieces(" " + unit)])

    def _plain(self, text: str) -> bytes:
        first, *rest = blank_cut(text)
        head = b"".join([self.piece[p] for p in self.pieces(first)])
        return head + b"".join(map(self.unit.__getitem__, rest))

    def split_specials(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches of a text, each with the special id that follows it."""
        while True:
            hits = [(at, -len(s), s) for s in self.specials if s and (at := text.find(s)) >= 0]
            if not hits:
                yield text, None
                return
            at, _, special = min(hits)
            yield text[:at], self.specials[special]
            text = text[at + len(special):]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.specials):
            return self._plain(text) if text else b""
        parts = []
        for stretch, special in self.split_specials(text):
            if stretch:
                parts.append(self._plain(stretch))
            if special is not None:
                parts.append(special.to_bytes(4, "little"))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters."""
        tokens = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, tokens)).decode("utf-8", "replace")


_encoders: dict[str, PrefixEncoder] = {}


def encoder(vocabulary: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = PrefixEncoder(vocabulary)
    return _encoders[vocabulary]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): the ids of each text as little-endian unsigned 32-bit integers."""
    return _encoded(docs, vocabulary, id_col, text_col, f"`{id_col}` {id_type(docs, id_col)}, ids binary", False)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and decoded from its ids."""
    columns = f"`{id_col}` {id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, vocabulary, id_col, text_col, columns, True)


def _encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, columns: str, digests: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches):
        coder = encoder(vocabulary)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            names = batch.column(0)
            if not digests:
                yield pa.record_batch([names, pa.array([coder.encode(t) for t in texts_of(batch, text_col)], pa.binary())], [id_col, "ids"])
                continue
            counts, encoded, decoded = [], [], []
            for text in texts_of(batch, text_col):
                ids = coder.encode(text)
                counts.append(len(ids) // 4)
                encoded.append(sha(ids))
                decoded.append(sha(coder.decode(ids).encode()))
            yield pa.record_batch(
                [names, pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return text_rows(docs, id_col, text_col).mapInArrow(run, columns)
