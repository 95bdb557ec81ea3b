"""Token counts at every prefix of a text.

The prefix tokens of ``bpe`` give, for each prefix of a piece, the count of the prefix before its last
token plus one.  A text is the sum of its units, so the count at any position is the running count of
the units before it plus the stored count inside one stretch: truncation and budget questions need no
new encoding.

The border of two pieces can move when a text is cut there: a run of blanks is one piece at the end of
a text but gives its last character away if a visible one follows, and a contraction is a piece only if
it is complete.  The table inside a stretch holds the counts of the cut texts themselves.

Null and empty texts count zero tokens.  Repeated rows, null ids and further columns do no harm.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm.bpe import PrefixEncoder, encoder
from factorloom.llm.textunits import Memo, blank_cut, bounded_batches, id_type, text_rows, texts_of

_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
TABLE_MEMO = 100_000
UNIT_MEMO = 200_000


def piece_table(coder: PrefixEncoder, piece: str) -> tuple[int, ...]:
    """Token count of every prefix of one piece, by characters, the empty prefix first."""
    data = piece.encode()
    last, counts = coder.prefix_tokens(data), [0] * (len(data) + 1)
    for end in range(1, len(data) + 1):
        counts[end] = counts[end - len(coder.bytes_of[last[end]])] + 1
    if len(data) != len(piece):
        ends = [i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80]
        counts = [0, *[counts[i] for i in ends], counts[-1]]
    return tuple(counts)


def is_blank_run(piece: str) -> bool:
    """Whether a piece is white space as the vocabulary's pattern knows it."""
    return piece.isspace() and not "\x1c" <= piece[-1] <= "\x1f"


class PrefixCounter:
    """Counts of one vocabulary, from the prefix tables of its pieces."""

    def __init__(self, vocabulary: str):
        self.coder = encoder(vocabulary)
        self.piece = Memo(lambda p: piece_table(self.coder, p), TABLE_MEMO)
        self.unit = Memo(self._unit_total, UNIT_MEMO)

    def stretch_total(self, stretch: str) -> int:
        return sum(self.piece[p][-1] for p in self.coder.pieces(stretch)) if stretch else 0

    def _unit_total(self, unit: str) -> int:
        if unit.isascii() and unit.isalpha():
            return self.piece[" " + unit][-1]
        return self.stretch_total(" " + unit)

    def stretch_table(self, stretch: str) -> list[int]:
        """Count of every prefix of an ordinary stretch, by characters, the empty prefix first."""
        counts, base, blanks = [0], 0, ""
        pieces = self.coder.pieces(stretch)
        for k, piece in enumerate(pieces):
            if is_blank_run(piece):
                blanks += piece
                following = pieces[k + 1] if k + 1 < len(pieces) else ""
                if is_blank_run(following):
                    continue
                given = following[:1] == " "  # the run's last blank belongs to the next piece
                run = blanks + " " * given
                inside = self.piece[run]
                counts += [base + n for n in inside[1:]]
                base += self.piece[blanks][-1] if given or len(blanks) == 1 or not following else (
                    self.piece[blanks[:-1]][-1] + self.piece[blanks[-1]][-1]
                )
                continue
            inside = self.piece[piece]
            skipped = bool(blanks) and piece[0] == " "  # counted as the end of the run
            blanks = ""
            if len(piece) == 3 and _CONTRACTION.fullmatch(piece):
                inside = (0, 1, 1 + self.piece[piece[1]][-1], inside[-1])
            counts += [base + n for n in inside[1 + skipped:]]
            base += inside[-1]
        return counts


class PrefixTable:
    """Exact count at every prefix of one text, positions in characters."""

    def __init__(self, counter: PrefixCounter, text: str):
        self._counter, self.text = counter, text
        lengths, totals, clean, specials = [], [], [], set()
        for stretch, special in counter.coder.split_specials(text):
            if stretch:
                first, *rest = blank_cut(stretch)
                lengths += [len(first), *map((1).__add__, map(len, rest))]
                totals += [counter.stretch_total(first), *map(counter.unit.__getitem__, rest)]
                clean += [True, *[not u[-1:].isspace() and u != "" for u in (first, *rest[:-1])]] if rest else [True]
            if special is not None:
                specials.add(len(lengths))
                lengths.append(len(counter.coder.bytes_of[special].decode()))
                totals.append(1)
                clean.append(True)
        self.starts = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.array(totals, dtype=np.int64))]).astype(np.int64)
        self._clean = [*clean, True]  # whether the count at the unit's start stands on its own
        self.n_tokens = int(self.before[-1])
        self._special = specials
        self._stored: dict[tuple[int, int], list[int]] = {}

    def _stretch(self, unit: int) -> tuple[int, list[int]]:
        """First unit and table of the stretch around a unit."""
        low, high = unit, unit + 1
        cut_special = unit in self._special  # cut inside, it is ordinary text behind the unit before it
        if cut_special and unit and unit - 1 not in self._special:
            low -= 1
        while not self._clean[low]:
            low -= 1
        while not self._clean[high]:
            high += 1
        if (low, high) not in self._stored:
            part = self.text[self.starts[low]: self.starts[high]]
            whole = int(self.before[high] - self.before[low])
            self._stored[low, high] = (
                [*self._counter.stretch_table(part[:-1]), whole] if cut_special else self._counter.stretch_table(part)
            )
        return low, self._stored[low, high]

    def count_at(self, position: int) -> int:
        """Tokens of the text cut after so many characters."""
        if not 0 < position <= len(self.text):
            return 0
        low, table = self._stretch(bisect_left(self.starts, position) - 1)
        return int(self.before[low]) + table[position - int(self.starts[low])]

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens.

        Counts do not fall from stretch to stretch but may inside one, so the stretch is found by
        bisection of the running counts and searched from its end.
        """
        if self.n_tokens <= budget:
            return len(self.text)
        unit = bisect_right(self.before, budget) - 1
        while unit >= 0:
            low, table = self._stretch(unit)
            for inside in range(len(table) - 1, 0, -1):
                if self.before[low] + table[inside] <= budget:
                    return int(self.starts[low]) + inside
            unit = low - 1
        return 0


_counters: dict[str, PrefixCounter] = {}


def counter(vocabulary: str) -> PrefixCounter:
    if vocabulary not in _counters:
        _counters[vocabulary] = PrefixCounter(vocabulary)
    return _counters[vocabulary]


def token_counts(
    docs: DataFrame, vocabulary: str, budget: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit, chars_within): the last is the longest prefix within the budget."""
    bounded_batches(docs.sparkSession)
    columns = f"`{id_col}` {id_type(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean, chars_within long"

    def run(batches):
        counts = counter(vocabulary)
        for batch in batches:
            sizes, tokens, within = [], [], []
            for text in texts_of(batch, text_col):
                table = PrefixTable(counts, text)
                sizes.append(len(text.encode()))
                tokens.append(table.n_tokens)
                within.append(table.longest_within(budget))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([t > budget for t in tokens], pa.bool_()), pa.array(within, pa.int64())],
                [id_col, "n_bytes", "n_tokens", "over_limit", "chars_within"],
            )

    return text_rows(docs, id_col, text_col).mapInArrow(run, columns)
