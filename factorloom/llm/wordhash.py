"""Words of a column of texts as flat arrays, found and hashed on bytes.

A word is a longest run of ASCII letters, digits and characters outside ASCII; A-Z count as a-z.  Every byte of a
character outside ASCII is 0x80 or above, so words are cut and hashed on the bytes of UTF-8.  The hash of a
word is the value of a polynomial over its bytes, taken from running sums, so that all words of a block cost
a few passes over it.  Hashes only select; whoever uses them compares the words themselves before a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from factorloom.llm.textunits import utf8_buffer

#: Bytes handled at a time; a longer word is handled as a whole.
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)

#: What each byte counts as inside a word; 0 for bytes of no word.
_FOLDED = np.zeros(256, np.uint8)
for _first, _last, _shift in ((0x30, 0x39, 0), (0x41, 0x5A, 0x20), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    _FOLDED[_first: _last + 1] = np.arange(_first + _shift, _last + _shift + 1)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, count: int) -> np.ndarray:
    """Powers 0, 1, ... of the base, or of its inverse, modulo 2^64."""
    if len(_powers[kind]) < count:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(count, PIECE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


@dataclass
class Block:
    """Words of the rows ``first`` to ``first + rows - 1`` of a column, in order."""

    first: int
    rows: int
    raw: np.ndarray  # folded bytes of the rows
    row: np.ndarray  # of each word, from 0
    start: np.ndarray  # byte of ``raw`` where the word begins
    end: np.ndarray
    hash: np.ndarray

    def word(self, k: int) -> bytes:
        return self.raw[self.start[k]: self.end[k]].tobytes()

    def words(self, picked=slice(None)) -> list[bytes]:
        text, starts, ends = self.raw.tobytes(), self.start[picked].tolist(), self.end[picked].tolist()
        return [text[a:b] for a, b in zip(starts, ends, strict=True)]


def _hashed_piece(folded: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of folded bytes; a word never runs over a break."""
    inside = folded != 0
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[breaks] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(folded.astype(np.uint64) * _power("up", len(folded)), out=sums[1:])
    down = _power("down", len(folded) + 1)
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts])


def word_blocks(column: pa.Array, most_bytes: int = PIECE_BYTES) -> Iterator[Block]:
    """The words of a string column in blocks of consecutive rows; a row is never split, null counts as empty."""
    raw, bounds = utf8_buffer(column)
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), rows)
        folded = _FOLDED[raw[bounds[first]: bounds[last]]]
        inner = bounds[first: last + 1] - bounds[first]
        found, at = [], 0
        while at < len(folded):
            end = min(at + most_bytes, len(folded))
            while end < len(folded) and folded[end]:  # a word stays whole
                gaps = np.flatnonzero(folded[end: end + most_bytes] == 0)
                end = end + int(gaps[0]) if len(gaps) else min(end + most_bytes, len(folded))
            breaks = inner[(inner >= at) & (inner < end)] - at
            starts, ends, hashes = _hashed_piece(folded[at:end], breaks)
            found.append((starts + at, ends + at, hashes))
            at = end
        starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        row = np.searchsorted(inner, starts, side="right") - 1
        yield Block(first, last - first, folded, row, starts, ends, hashes)
        first = last
