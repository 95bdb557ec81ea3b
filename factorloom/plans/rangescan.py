"""Running values of long ordered groups: a prefix scan over range partitions.

A window puts a whole group into one task, so one key with all rows is one task.  Here the
rows are cut into ranges of (key, order), and two passes give the same values: each range
computes its own running values, one summary row a key and range is carried forward over the
ranges, and the carry is combined with the running value of the row.  That needs operations
which are associative: last filled value, sum, product, smallest and largest value.

The carry of one key looks at no more rows than there are ranges.  A range holds about the
same number of rows whatever the keys are; only rows with equal key and order stay together.
Sums and products of doubles are added in another order than in a window, so their last
digits can differ.  Rows whose order is missing come first, rows of a missing key form a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

RANGE = "_range"

_OVER = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}


def _combined(kind: str, carried: Column, own: Column) -> Column:
    if kind == "last":
        return F.coalesce(own, carried)
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(carried, own)
    both = carried + own if kind == "sum" else carried * own
    return F.coalesce(both, own, carried)


def cut_into_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], *, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of the range that each row lies in; numbers ascend with key and order.

    The bounds come from Spark's sample, so the table is staged: every later step sees the same
    ranges.  The sample reads the input once more, so stage an input that is dear to compute.  By default there are as many as shuffle partitions.
    """
    if RANGE in df.columns:
        raise ValueError(f"the column name {RANGE} is taken")
    count = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(count, *by, *order).withColumn(RANGE, F.spark_partition_id())
    return stage(cut, "ranges")


def scan(
    cut: DataFrame, by: Sequence[str], order: Sequence[str], running: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Adds running values ``{name: (kind, column)}`` up to and including each row.

    ``kind`` is last (the latest filled value), sum, product, min or max; missing values are
    passed over.  ``order`` must place the rows of a key uniquely, otherwise rows of equal
    order are taken in an unstated order.
    """
    for name, (kind, _) in running.items():
        if kind != "last" and kind not in _OVER:
            raise ValueError(f"{name}: no running {kind}")
        if name in cut.columns:
            raise ValueError(f"the column name {name} is taken")
    keys = list(by)
    inside = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own, whole = {}, []
    for name, (kind, column) in running.items():
        if kind == "last":
            own[name] = F.last(column, ignorenulls=True).over(inside)
            place = F.when(F.col(column).isNotNull(), F.struct(*order))
            whole.append(F.max_by(column, place).alias(f"_all_{name}"))
        else:
            own[name] = _OVER[kind](column).over(inside)
            whole.append(_OVER[kind](column).alias(f"_all_{name}"))
    summaries = stage(cut.groupBy(RANGE, *keys).agg(*whole), "range_summaries")

    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carries = {}
    for name, (kind, _) in running.items():
        value = F.col(f"_all_{name}")
        over = F.last(value, ignorenulls=True) if kind == "last" else _OVER[kind](value)
        carries[f"_carry_{name}"] = over.over(before)
    carried = summaries.withColumns(carries).select(
        F.col(RANGE).alias("_at_range"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *carries
    )
    same = F.col(RANGE) == F.col("_at_range")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    joined = cut.withColumns(own).join(carried, same, "left")
    return joined.select(
        *cut.columns,
        *[_combined(kind, F.col(f"_carry_{n}"), F.col(n)).alias(n) for n, (kind, _) in running.items()],
    )
