"""As-of joins, compounding and drawdowns for keys that may hold all rows.

The window versions (`intervals.asof_backward`, `portfolio.with_cumulative`,
`metrics.max_drawdown`) rest on series of calendar length.  These take series of any length by
the range scan of `plans.rangescan`; on short series they give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rangescan import RANGE, cut_into_ranges, scan


def asof_backward_ranged(
    left: DataFrame, rights: Sequence[tuple[DataFrame, Sequence[str]]], *, key: str, left_date: str,
    right_date: str = "available_date", ranges: int | None = None,
) -> DataFrame:
    """Latest row of each right table whose date is on or before the left date, any key length.

    The right tables have one row per key and date.  Left rows of one key and date are spread by
    a hash of their values, so that a single hot day does not stay in one range either.
    """
    hashed = [f.name for f in left.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    stacked = left.withColumns({"_day": F.col(left_date), "_side": F.lit(1), "_spread": F.xxhash64(*hashed)})
    for number, (right, columns) in enumerate(rights):
        one = right.select(
            F.col(key), F.col(right_date).alias("_day"), F.lit(0).alias("_side"),
            F.lit(number).cast("long").alias("_spread"), F.struct(*columns).alias(f"_right{number}"),
        ).where(F.col(key).isNotNull() & F.col("_day").isNotNull())
        stacked = stacked.unionByName(one, allowMissingColumns=True)
    order = ["_day", "_side", "_spread"]
    cut = cut_into_ranges(stacked, [key], order, ranges=ranges)
    latest = {f"_latest{n}": ("last", f"_right{n}") for n in range(len(rights))}
    matched = scan(cut, [key], order, latest).where(F.col("_side") == 1)
    out = [F.col(c) for c in left.columns]
    for number, (_, columns) in enumerate(rights):
        out += [F.col(f"_latest{number}.{c}").alias(c) for c in columns]
    return matched.select(*out)


def equity_curve(
    returns: DataFrame, by: Sequence[str], *, value: str, order: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Compounded value, running peak and fall below it for each row with a return."""
    rows = returns.where(F.col(value).isNotNull()).withColumn("_growth", F.col(value) + 1)
    cut = cut_into_ranges(rows, by, order, ranges=ranges)
    compounded = scan(cut, by, order, {"equity": ("product", "_growth")})
    curve = scan(compounded, by, order, {"peak": ("max", "equity")})
    fall = F.col("equity") / F.nullif(F.col("peak"), F.lit(0.0)) - 1
    return curve.withColumn("drawdown", fall).drop(RANGE, "_growth")


def max_drawdown_ranged(
    returns: DataFrame, by: Sequence[str], *, value: str, order: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Deepest fall of the compounded returns below their running peak, any series length."""
    curve = equity_curve(returns, by, value=value, order=order, ranges=ranges)
    return curve.groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))
