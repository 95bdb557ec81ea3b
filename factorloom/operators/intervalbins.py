"""Interval joins in bins of time.

`intervals.join_active` compares every row of an identifier with every interval of it.  Here
intervals are cut into bins of days and the join is an equality on (identifier, bin): a row
meets the intervals of its own bin only, and the rows of one identifier spread over as many
keys as there are bins.  The residual condition decides, so the bins change the work and not
the result.  Days before the first and after the last bin belong to these two, which bounds
the pieces of an interval that never ends (about 200 by default).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import active_on, closed_end

BIN_DAYS = 366
FIRST_DAY = date(1900, 1, 1)
LAST_DAY = date(2100, 1, 1)
_EPOCH = date(1970, 1, 1)


def _bin_of(day: Column, width: int) -> Column:
    low, high = ((edge - _EPOCH).days // width for edge in (FIRST_DAY, LAST_DAY))
    number = F.floor(F.unix_date(day.cast("date")) / F.lit(width))
    return F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), number))


def _fresh(base: str, *frames: DataFrame) -> str:
    taken = {c.lower() for frame in frames for c in frame.columns}
    while base.lower() in taken:
        base += "_"
    return base


def _pieces(df: DataFrame, start: str, end: str, name: str, first: str, width: int) -> DataFrame:
    """One row a bin that the interval touches, with the interval's first bin; empty intervals have none."""
    valid = df.where(F.col(start) <= closed_end(end)).withColumn(first, _bin_of(F.col(start), width))
    return valid.withColumn(name, F.explode(F.sequence(F.col(first), _bin_of(closed_end(end), width))))


def join_active_binned(
    rows: DataFrame, intervals: DataFrame, on: str, day: str, start: str, end: str, *, bin_days: int = BIN_DAYS
) -> DataFrame:
    """Rows with every different interval of the same identifier that contains the day.

    Same rows and columns as `intervals.join_active`.  A day lies in one bin, so no match is
    found twice.
    """
    at, first, other = (_fresh(n, rows, intervals) for n in ("_bin", "_first", "_on"))
    right = _pieces(intervals.withColumnRenamed(on, other).distinct(), start, end, at, first, bin_days)
    right = right.drop(first).withColumnRenamed(at, f"{at}r")
    left = rows.withColumn(at, _bin_of(F.col(day), bin_days))
    inside = active_on(left[day], right[start], right[end])
    met = (left[on] == right[other]) & (left[at] == right[f"{at}r"])
    return left.join(right, met & inside).drop(other, at, f"{at}r")


def overlap_join_binned(
    left: DataFrame, right: DataFrame, *, on: str, right_on: str, left_span: tuple[str, str],
    right_span: tuple[str, str], bin_days: int = BIN_DAYS,
) -> DataFrame:
    """Pairs of intervals of the same identifier that share a day; open ends never expire.

    Both sides are cut into bins.  Two intervals can meet in many bins; the pair is reported by
    the first one they share, which is the later of their first bins.  Repeated rows stay
    repeated.  The column names of the two sides must differ.
    """
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    at, first = (_fresh(n, left, right) for n in ("_bin", "_first"))
    a = _pieces(left, *left_span, f"{at}a", f"{first}a", bin_days)
    b = _pieces(right, *right_span, f"{at}b", f"{first}b", bin_days)
    met = (F.col(on) == F.col(right_on)) & (F.col(f"{at}a") == F.col(f"{at}b"))
    once = F.col(f"{at}a") == F.greatest(f"{first}a", f"{first}b")
    shares = (F.col(left_span[0]) <= closed_end(right_span[1])) & (F.col(right_span[0]) <= closed_end(left_span[1]))
    return a.join(b, met & once & shares).select(*left.columns, *right.columns)
