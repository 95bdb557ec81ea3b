"""A filter of fixed size over 64-bit hashes: which of 2^25 cells hold one.

It never turns a hash away that is there, so it only thins what leaves a scan before an exact join.  Its size does
not depend on the number of hashes: the cells are folded into words of 64 by an aggregation, and the words
that the driver receives are at most 2^19.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_BITS = 25


def cells_of(hashes: DataFrame, column: str) -> np.ndarray:
    """The filter of a column of hashes (long), as words of 64 cells."""
    cell = F.shiftrightunsigned(F.col(column), 64 - CELL_BITS)
    bit = F.expr("shiftleft(1L, cast(cell % 64 as int))")
    folded = hashes.where(F.col(column).isNotNull()).select(cell.alias("cell")).groupBy(
        F.expr("cell div 64").alias("word")
    ).agg(F.bit_or(bit).alias("bits"))
    words = np.zeros(1 << (CELL_BITS - 6), np.int64)
    table = folded.toArrow()  # at most 2^19 rows
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return words.view(np.uint64)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of unsigned 64-bit hashes fall into a cell of the filter."""
    cell = hashes >> np.uint64(64 - CELL_BITS)
    return (words[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) != 0
