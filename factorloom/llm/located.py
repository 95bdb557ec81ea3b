"""Rows of a table with the place of their content: file and row number inside it.

The columns of the table travel inside one structure, so that none of them, whatever its name, can clash
with the place or with the file system's own metadata column.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.plans.staging import stage

HELD, FILE, ROW = "_at_held", "_at_file", "_at_row"
PLACE = (FILE, ROW)


def with_place(docs: DataFrame) -> DataFrame:
    """Rows (held, file, row): the table's columns in one structure and the place of each row, the same at every reading.

    A table that is not read straight from files is written to the shared folder first.
    """
    try:
        return _placed(docs)
    except AnalysisException:
        return _placed(stage(docs, "located"))


def _placed(docs: DataFrame) -> DataFrame:
    at = docs.metadataColumn("_metadata")
    held = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])
    return docs.select(held.alias(HELD), at["file_path"].alias(FILE), at["row_index"].alias(ROW))


def held(column: str) -> Column:
    """A column of the table that was located."""
    return F.col(HELD).getField(column)


def given_back(placed: DataFrame, **changed: Column) -> DataFrame:
    """The table's own columns, in their order; ``changed`` gives new values for some."""
    names = placed.schema[HELD].dataType.names
    return placed.select(*[changed.get(c, held(c)).alias(c) for c in names])
