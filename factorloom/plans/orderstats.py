"""Exact order statistics per group without putting a group into one task.

A cross section is one date, so there are few groups and each grows with the data; a sort
of a whole group in one window task does not scale.  Instead the values are counted in
cells that keep their order, level by level: for doubles sign, exponent and 8 mantissa
bits (for a wanted rank 3 of them first), then 22 more bits, then the value itself; for whole numbers (ids too) the upper,
middle and lower bits by integer arithmetic, so that no id passes through a double.  The
counts shrink before the shuffle, a running sum over the cells of a group finds the cell of
a wanted rank, and only the rows of that cell are looked at again.  Every window runs over
the cells of one level, whose number is bounded by the width of the type and not by the
number of rows.  NULL, NaN and infinite values are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage


def _magnitude(value: Column) -> tuple[Column, Column]:
    """Exponent e with 2^e <= |value| < 2^(e+1), and that power of two."""
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("double")
    power = F.pow(F.lit(2.0), guess)
    exponent = guess - (size < power).cast("double") + (size >= power * 2).cast("double")
    return exponent, F.pow(F.lit(2.0), exponent)


def wide_cell(value: Column) -> Column:
    """Order-keeping cell number with 8 cells per power of two, each made of 32 coarse cells."""
    exponent, power = _magnitude(value)
    step = F.floor((F.abs(value) / power - 1) * 8)
    return F.coalesce((F.signum(value) * ((exponent + 1100) * 8 + step + 1)).cast("long"), F.lit(0).cast("long"))


def coarse_cell(value: Column) -> Column:
    """Order-keeping cell number with 256 cells per power of two (at most about 1.1 M)."""
    exponent, power = _magnitude(value)
    step = F.floor((F.abs(value) / power - 1) * 256)
    # the logarithm of zero is NULL; shared subexpressions are computed once in this form
    return F.coalesce((F.signum(value) * ((exponent + 1100) * 256 + step + 1)).cast("long"), F.lit(0).cast("long"))


def fine_cell(value: Column) -> Column:
    """Order-keeping cell number inside one coarse cell (at most 2^22)."""
    _, power = _magnitude(value)
    scaled = (F.abs(value) / power - 1) * 256
    step = F.floor((scaled - F.floor(scaled)) * 4194304)
    return F.coalesce((F.signum(value) * step).cast("long"), F.lit(0).cast("long"))


def _exact(df: DataFrame, column: str) -> Column:
    """The column as long or double, non-finite values as NULL; other types are refused."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long")
    if isinstance(kind, (T.FractionalType, T.BooleanType)):
        value = F.col(column).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    raise TypeError(f"{column}: order statistics need a number, not {kind.simpleString()}")


def _levels(df: DataFrame, column: str) -> list[Column]:
    """Cell numbers from coarse to exact; equal last cells mean equal values."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.LongType):
        return [F.shiftright(value, 42), F.shiftright(value, 21), value]
    return [coarse_cell(value), fine_cell(value), value]


def _running_counts(cells: DataFrame, path: Sequence[str], order: Sequence[str]) -> DataFrame:
    through = F.sum("n").over(
        Window.partitionBy(*path).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return cells.withColumn("through", through).withColumn("before", F.col("through") - F.col("n"))


def pick_ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    *,
    tie: str | None = None,
    group_info: DataFrame | None = None,
) -> DataFrame:
    """Value at each wanted 0-based rank of each group, in the order (value, tie).

    ``ranks`` maps a name to a function of the group size; with ``group_info`` (one row per
    group) its columns may be used too.  Ranks outside the group give no row.  Rows with a
    missing key or value are left out.  Result: keys, pick, value, tie, group_rows.

    ``df`` is read twice if ``value`` is a double (its rows in the wanted wide cells are staged)
    and once for each level otherwise, so it should be a staged table if it is costly to compute.
    """
    keys = list(keys)
    columns = [*(F.col(k) for k in keys), _exact(df, value).alias("v")]
    if tie:
        columns.append(_exact(df, tie).alias("t"))
    rows = df.select(*columns).dropna()
    # few wide cells come first: the rows that a task has of a group shrink to counts before the shuffle
    wide = [] if isinstance(rows.schema["v"].dataType, T.LongType) else [wide_cell(F.col("v"))]
    of_value = [*wide, *_levels(rows, "v")]
    levels = of_value + (_levels(rows, "t") if tie else [])
    names = [f"cell{k}" for k in range(len(levels))]
    rows = rows.withColumn("cell0", levels[0])

    counted = rows.groupBy(*keys, "cell0").agg(F.count(F.lit(1)).alias("n"))
    counted = _running_counts(counted, keys, ["cell0"]).withColumn("group_rows", F.sum("n").over(Window.partitionBy(*keys)))
    if group_info is not None:
        counted = counted.join(group_info, keys)
    size = F.col("group_rows")
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("pick"), f(size).cast("long").alias("rank")) for n, f in ranks.items()])
    )
    within = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("through"))
    inner = (F.col("rank") - F.col("before")).alias("rank")
    targets = counted.withColumn("w", wanted).withColumn("rank", F.col("w.rank")).where(within).select(
        *keys, "cell0", "group_rows", "w.pick", inner
    )
    for k in range(1, len(levels)):
        path = [*keys, *names[:k]]
        targets = stage(targets, "targets")
        if k == 1:
            if wide:
                rows = stage(rows.join(targets.select(*path).distinct(), path, "left_semi"), "inside")
            rows = rows.withColumns(dict(zip(names[1:], levels[1:], strict=True)))
        inside = rows.join(targets.select(*path).distinct(), path, "left_semi").groupBy(*path, names[k])
        counts = _running_counts(inside.agg(F.count(F.lit(1)).alias("n")), path, [names[k]])
        targets = counts.join(targets, path).where(within).select(*path, names[k], "group_rows", "pick", inner)
    out = [*keys, "pick", F.col(names[len(of_value) - 1]).alias("value")]
    if tie:
        out.append(F.col(names[-1]).alias("tie"))
    return targets.select(*out, "group_rows")


def quantile_position(n: Column, q: float) -> Column:
    """0-based place of a quantile among ``n`` rows; one that misses a whole number by rounding alone is that number."""
    place = (n - 1) * F.lit(float(q))
    near = F.rint(place)
    return F.when(F.abs(place - near) <= F.greatest(F.lit(1.0), place) * 1e-12, near).otherwise(place)


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles: keys, group_rows and one column per name.

    A position that misses a whole number by rounding alone is that number, so a cut that
    falls on a row equals the row's value."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in quantiles.items():
        ranks[f"{name}:low"] = lambda n, q=q: F.floor(quantile_position(n, q))
        ranks[f"{name}:high"] = lambda n, q=q: F.ceil(quantile_position(n, q))
    picks = pick_ranked(df, keys, value, ranks)
    wide = picks.groupBy(*keys).agg(
        F.max("group_rows").alias("group_rows"),
        *[F.max(F.when(F.col("pick") == name, F.col("value"))).alias(name) for name in ranks],
    )
    result = [F.col(k) for k in keys] + [F.col("group_rows")]
    for name, q in quantiles.items():
        place = quantile_position(F.col("group_rows"), q)
        low, high = F.col(f"`{name}:low`"), F.col(f"`{name}:high`")
        result.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return wide.select(*result)


def distinct_value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group and distinct value: rows below it, rows equal to it, average rank."""
    keys = list(keys)
    values = df.select(*keys, _exact(df, value).alias("v")).dropna().groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    first, second, _ = _levels(values, "v")
    values = stage(values.withColumns({"cell": first, "fine": second}), "values")
    cells = values.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    below = _running_counts(cells, keys, ["cell"]).select(*keys, "cell", F.col("before").alias("below_cell"))
    path = [*keys, "cell"]
    split = values.groupBy(*path, "fine").agg(F.sum("n").alias("n"))
    split = _running_counts(split, path, ["fine"]).select(*path, "fine", F.col("before").alias("below_fine"))
    ranked = _running_counts(values, [*path, "fine"], ["v"]).join(split, [*path, "fine"]).join(below, path)
    smaller = F.col("below_cell") + F.col("below_fine") + F.col("before")
    return ranked.select(
        *keys, "v", smaller.alias("rows_below"), F.col("n").alias("rows_equal"),
        (smaller + (F.col("n") + 1) / 2).alias("average_rank"),
    )


def ordinal_ranks(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """Add the 1-based rank by (value, tie) within each group; tie tells equal values apart.

    Equal values are ranked among themselves by a second counting of the tie column, so even
    a value shared by a large part of a group is never sorted in one task.
    """
    keys = list(keys)
    rows = df.withColumns({"_v": _exact(df, value), "_t": _exact(df, tie)})
    by_value = distinct_value_ranks(rows, keys, "_v").select(
        *keys, F.col("v").alias("_v"), F.col("rows_below").alias("_below"), "rows_equal"
    )
    by_value = stage(by_value, "value_ranks")
    tied = rows.join(by_value.where(F.col("rows_equal") > 1).select(*keys, "_v"), [*keys, "_v"], "left_semi")
    by_tie = distinct_value_ranks(tied, [*keys, "_v"], "_t").select(
        *keys, "_v", F.col("v").alias("_t"), F.col("rows_below").alias("_tie_below")
    )
    ranked = rows.join(by_value.drop("rows_equal"), [*keys, "_v"], "left").join(by_tie, [*keys, "_v", "_t"], "left")
    return ranked.withColumn(out, F.col("_below") + F.coalesce("_tie_below", F.lit(0)) + 1).drop(
        "_v", "_t", "_below", "_tie_below"
    )
