"""Column expressions shared by every operator.

Missing values are NULL everywhere.  NaN and infinities are turned into NULL when a
table is read, because Spark sorts NaN above every number and counts it as a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN_END = "2262-04-11"
DENOMINATOR_FLOOR = 1e-12


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_number(value: Column | str) -> Column:
    """Number or NULL; never raises, also under ANSI mode."""
    number = col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def as_long(value: Column | str) -> Column:
    return col(value).try_cast("long")


def as_date(df: DataFrame, name: str) -> Column:
    """A column of ``df`` as date or NULL; text and timestamps are accepted.

    A date column is passed through untouched, so filters on it still reach the scan."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(name)
    return F.to_date(F.try_to_timestamp(F.col(name).cast("string")))


def normalized_text(value: Column | str) -> Column:
    """Upper case without white space at the edges; NULL becomes the empty string."""
    return F.upper(F.btrim(F.coalesce(col(value).cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r")))


def zero_padded(value: Column | str, width: int = 6) -> Column:
    """Left-pad with zeros; longer codes stay whole."""
    text = col(value).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.when(F.abs(denominator) > DENOMINATOR_FLOOR, numerator / denominator)


def closed_end(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(OPEN_END).cast("date"))


def active_on(day: Column, start: Column, end: Column) -> Column:
    """Both ends count; an open end never expires, a missing start is never active."""
    return start.isNotNull() & (start <= day) & (day <= closed_end(end))


def clipped(value: Column, low: float, high: float) -> Column:
    """greatest/least skip NULL, so the guard keeps missing values missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def nulled_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities of every float column become NULL."""
    fields = [
        F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) != float("inf")), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*fields)


def fixed_point(value: Column | str, digits: int = 6) -> Column:
    """Round for reports.  The cut sits a little below one half, so that sums added in a
    different order do not fall on different sides of a decimal tie.  Values too large to
    have such digits stay as they are."""
    scale = float(10**digits)
    x = col(value)
    small = F.when(F.abs(x) < 9e15 / scale, x)
    return F.when(F.abs(x) >= 9e15 / scale, x).otherwise(
        F.floor(small * F.lit(scale) + F.lit(0.5001)).cast("double") / F.lit(scale)
    )


def fixed_growth(value: Column | str) -> Column:
    """Compounded growth can be huge; the number of digits kept falls with its size."""
    x = col(value)
    return (
        F.when(x < 1e3, fixed_point(F.when(x < 1e3, x)))
        .when(x < 1e9, fixed_point(F.when(x < 1e9, x), 2))
        .when(x < 1e15, F.floor(F.when(x < 1e15, x) / 1e6 + 0.5001).cast("double") * 1e6)
        .otherwise(F.rint(x / 1e15) * 1e15)
    )


def guarded_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the pairs where both are present; NULL for fewer than two
    pairs or a constant side (the built-in raises on a constant under ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.when((F.count(xs) > 1) & (spread > 0), F.covar_pop(xs, ys) / F.nullif(spread, F.lit(0.0)))


def json_payload(columns: Sequence[str]) -> Column:
    """JSON object of the columns in the order of their names, missing values as null."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def json_fields(payload: Column | str) -> Column:
    """Fields of a JSON object as text; no payload has none, and any other value is the field ``value``."""
    text = F.trim(col(payload))
    fields = F.from_json(text, "map<string,string>")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(text.startswith("{"), fields).when(F.length(text) > 0, F.create_map(F.lit("value"), text)).otherwise(none)
