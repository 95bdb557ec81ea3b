"""Shared helpers of the text operators: bounded memos, exact cutting of texts, Arrow columns.

A byte-level or word-level BPE vocabulary first cuts a text into pieces and then merges inside each
piece, so the ids of a piece do not depend on its neighbours.  Texts are cut here at blanks that are
followed by a visible character, which is always a piece boundary, and the ids of each unit are
remembered in a memo of bounded size.  The memo changes the time only, never the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.shipping import ship_package

#: Rows of one Arrow batch: bounds what a Python worker holds of long texts.
BATCH_ROWS = 1000

_CUT = re.compile(r" (?=\S)")
_OTHER_BLANKS = re.compile(
    "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]"
)
#: Characters whose class (letter or not) is the same in every Unicode version in use.
_PLAIN = re.compile("[\n\t -~À-ÖØ-öø-ɏ‘’“”–—…]*")
_PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+"
)


class Memo(dict):
    """Remembers computed values of short keys in two generations of at most ``limit`` entries each."""

    def __init__(self, compute: Callable, limit: int, longest: int = 64):
        super().__init__()
        self._compute, self._limit, self._longest, self._older = compute, limit, longest, {}

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self._compute(key)
        if len(key) <= self._longest:
            if len(self) >= self._limit:
                self._older = self.copy()
                self.clear()
            self[key] = value
        return value


def blank_cut(text: str) -> list[str]:
    """The first unit, then the units that each follow one blank; the blanks are left out."""
    if "  " in text or " \n" in text or text.endswith(" ") or _OTHER_BLANKS.search(text):
        return _CUT.split(text)
    return text.split(" ")


def byte_level_pieces(unit: str, fallback: Callable[[str], list[str]]) -> list[str]:
    """Pieces of a unit under the byte-level pattern; ``fallback`` serves rarer characters."""
    if _PLAIN.fullmatch(unit):
        return _PIECE.findall(unit)
    return fallback(unit)


def library_pieces(tokenizer) -> Callable[[str], list[str]]:
    """The tokenizer's own cutting, as parts of the given text."""

    def cut(unit: str) -> list[str]:
        return [unit[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    return cut


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further columns of any name cannot clash."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, as texts can be very long, and give the workers the package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_type(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """Texts of a batch one by one; null counts as empty."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw[:0], bounds - bounds[0]
