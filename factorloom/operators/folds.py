"""Expanding folds from running sums.

A fold of the walk-forward scheme trains on every date before its validation dates, so the training sets are
prefixes of each factor's history.  The history is cut into blocks at the ends of these prefixes, and a block is summed up
once: the products of all pairs of its columns, their smallest and largest values.  Running sums over the blocks
of a factor then give the statistics of every fold; no row is copied for a fold it trains.  Linear models are solved
from these statistics alone, one small system for each factor and fold.

Missing values are filled with the training median, which is no sum.  A column with gaps therefore enters
twice, as value (0 where missing) and as mark of the gap: the products of the filled column follow from those of the
two for any fill.  The medians themselves come from a running window over a factor's dates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shipping import ship_package
from ..plans.staging import stage

KEY, DATE = "factor_id", "formation_date"
#: Weights of the standardised columns from Gram matrix, target products and row count.
Solve = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


@dataclass(frozen=True)
class FoldRows:
    """Rows of the factors, each once, with the folds they take part in."""

    rows: DataFrame  # block: first fold that trains on the row; tested_by; validated_by: first and last fold
    features: tuple[str, ...]
    target: str


def fold_rows(
    frame: DataFrame, features: Sequence[str], target: str, *, min_observations: int = 24, validation_periods: int = 12,
    test_periods: int = 12,
) -> FoldRows:
    """Number the blocks and folds of every row of the factors that have enough rows for one fold."""
    step, ahead = max(1, test_periods), max(0, validation_periods)
    least = max(1, min_observations)
    by_factor = Window.partitionBy(KEY)
    rows = frame.where(F.col(target).isNotNull()).withColumns(
        {"i": F.row_number().over(by_factor.orderBy(DATE)) - 1, "n": F.count(F.lit(1)).over(by_factor)}
    )
    folds = F.greatest(F.lit(0), F.ceil((F.col("n") - least - ahead) / step)).cast("int")
    past = lambda start: F.floor((F.col("i") - F.lit(start)) / step).cast("int")
    rows = rows.where(F.col("n") >= min_observations).withColumn("folds", folds).where("folds > 0").select(
        DATE, KEY, F.col(target).cast("double").alias(target), *[F.col(f).cast("double").alias(f) for f in features], "folds",
        F.greatest(F.lit(0), past(least) + 1).alias("block"),
        F.when(F.col("i") >= least + ahead, past(least + ahead)).alias("tested_by"),
        F.greatest(F.lit(0), past(least + ahead) + 1).alias("validated_from"),
        F.least(F.col("folds") - 1, past(least)).alias("validated_to"),
    )
    return FoldRows(rows, tuple(features), target)


def evaluated(held: FoldRows) -> DataFrame:
    """Validation and test rows with role and fold: at most one test row and the validation rows of each date."""
    span = F.when(F.col("validated_from") <= F.col("validated_to"), F.sequence("validated_from", "validated_to"))
    as_part = lambda fold, role: F.struct(fold.alias("fold"), F.lit(role).alias("role"))
    validated = F.coalesce(F.transform(span, lambda f: as_part(f, "validation")), F.array().cast("array<struct<fold:int,role:string>>"))
    tested = F.when(F.col("tested_by").isNotNull(), F.array(as_part(F.col("tested_by"), "holdout"))).otherwise(
        F.array().cast("array<struct<fold:int,role:string>>")
    )
    return held.rows.select(DATE, KEY, held.target, *held.features, F.inline(F.concat(validated, tested)))


def _positions(held: FoldRows, gaps: Sequence[str]) -> dict[str, int]:
    """Place of each entry of a row's vector: the constant, the values, the gap marks, the target."""
    names = ["1", *held.features, *[f"?{f}" for f in gaps], "y"]
    return {name: k for k, name in enumerate(names)}


def fold_statistics(held: FoldRows, centers: dict[str, float], gaps: Sequence[str]) -> DataFrame:
    """Rows (factor, fold, sums, least, most): the training statistics of every fold.

    ``sums`` lists (a, b, total) for all pairs a <= b of the row vector's entries; ``least`` and ``most`` are
    arrays over the features.  Values are taken from ``centers`` on, which keeps the products small.
    """
    features = held.features
    value = {f: F.coalesce(F.col(f) - F.lit(centers[f]), F.lit(0.0)) for f in features}
    vector = F.array(
        F.lit(1.0), *[value[f] for f in features], *[F.col(f).isNull().cast("double") for f in gaps], F.col(held.target)
    )
    size = 2 + len(features) + len(gaps)
    rows = held.rows.where("block < folds").select(KEY, "block", "folds", vector.alias("z"))
    pairs = F.transform(F.lit(np.arange(size, dtype="int32")), lambda a: F.transform(
        F.sequence(a, F.lit(size - 1)), lambda b: F.struct(a.alias("a"), b.alias("b"), (F.get("z", a) * F.get("z", b)).alias("v"))
    ))
    blocks = rows.select(KEY, "block", "folds", F.inline(F.flatten(pairs))).groupBy(KEY, "folds", "block", "a", "b").agg(
        F.sum("v").alias("total")
    )
    over = Window.partitionBy(KEY, "a", "b").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = blocks.withColumn("total", F.sum("total").over(over))
    sums = running.groupBy(KEY, F.col("block").alias("fold")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "total"))).alias("sums"))
    ends = held.rows.where("block < folds").groupBy(KEY, "block").agg(
        F.count(F.lit(1)).alias("rows"), *[F.min(f).alias(f"least_{k}") for k, f in enumerate(features)], *[F.max(f).alias(f"most_{k}") for k, f in enumerate(features)]
    )
    before = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.select(
        KEY, F.col("block").alias("fold"),
        F.array(*[F.min(f"least_{k}").over(before) for k in range(len(features))]).cast("array<double>").alias("least"),
        F.array(*[F.max(f"most_{k}").over(before) for k in range(len(features))]).cast("array<double>").alias("most"),
    )
    return sums.join(ends, [KEY, "fold"])


def fold_medians(held: FoldRows, columns: Sequence[str]) -> DataFrame:
    """Rows (factor, fold, medians): the training median of each column, over a factor's dates in order."""
    running = Window.partitionBy(KEY).orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.array(*[F.percentile(c, F.lit(0.5)).over(running) for c in columns]).alias("medians")
    rows = held.rows.where("block < folds").select(KEY, DATE, F.col("block").alias("fold"), so_far)
    return rows.groupBy(KEY, "fold").agg(F.max_by("medians", DATE).alias("medians"))


def column_facts(held: FoldRows) -> tuple[dict[str, float], list[str]]:
    """A middle value of each feature and the features with gaps: one row on the driver."""
    facts = held.rows.agg(
        *[F.avg(f).alias(f"mean_{k}") for k, f in enumerate(held.features)],
        *[F.max(F.col(f).isNull()).alias(f"gap_{k}") for k, f in enumerate(held.features)], F.count(F.lit(1)).alias("rows"),
    ).first()
    centers = {f: facts[f"mean_{k}"] or 0.0 for k, f in enumerate(held.features)}
    return centers, [f for k, f in enumerate(held.features) if facts[f"gap_{k}"]]


class Normal:
    """Normal equations of one fold: standardised columns, missing values at the training median."""

    def __init__(self, sums: np.ndarray, least, most, medians, features: int, gap_at: list[int]):
        size = 2 + features + len(gap_at)
        whole = np.zeros((size, size))
        whole[np.triu_indices(size)] = sums
        whole = whole + np.triu(whole, 1).T
        self.rows = whole[0, 0]
        fill = np.zeros(features)
        take = np.zeros((features + 2, size))  # constant, filled columns, target
        take[0, 0], take[-1, -1] = 1, 1
        for k in range(features):
            take[1 + k, 1 + k] = 1
        for g, k in enumerate(gap_at):
            fill[k] = medians[g] if medians[g] is not None else 0.0
            take[1 + k, 1 + features + g] = fill[k]
        filled = take @ whole @ take.T
        mean, target_mean = filled[0, 1:-1] / self.rows, filled[0, -1] / self.rows
        spread = np.maximum(np.diag(filled)[1:-1] / self.rows - mean**2, 0.0)
        seen = np.array([a is not None for a in least], bool)
        moving = np.array([a is not None and a < b for a, b in zip(least, most, strict=True)], bool)
        self.used = np.flatnonzero(seen)
        self.fill, self.mean, self.target_mean = fill, mean, target_mean
        self.scale = np.where(moving & (spread > 0), np.sqrt(spread), 1.0)
        gram = filled[1:-1, 1:-1] - self.rows * np.outer(mean, mean)
        target = filled[1:-1, -1] - self.rows * mean * target_mean
        still = ~(moving & (spread > 0))
        gram[still, :], gram[:, still], target[still] = 0.0, 0.0, 0.0
        self.gram = gram / np.outer(self.scale, self.scale)
        self.target = target / self.scale


def _normals(statistics: DataFrame, medians: DataFrame | None, make, shape: str, features: int, gap_at: list[int]) -> DataFrame:
    """Run ``make(normal)`` on every (factor, fold); it gives the columns after factor and fold."""
    if medians is None:
        whole = statistics.withColumn("medians", F.array().cast("array<double>"))
    else:
        whole = statistics.join(medians, [KEY, "fold"])
    whole = whole.select(KEY, "fold", F.transform("sums", lambda s: s["total"]).alias("sums"), "least", "most", "medians")

    shape = f"{KEY} string, fold int, {shape}"
    arrow = to_arrow_schema(T.StructType.fromDDL(shape))

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                normal = Normal(np.array(row["sums"]), row["least"], row["most"], row["medians"], features, gap_at)
                out += [{KEY: row[KEY], "fold": row["fold"], **made} for made in make(normal)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ship_package(statistics.sparkSession)
    return whole.mapInArrow(solve, shape)


def _prepared(held: FoldRows):
    centers, gaps = column_facts(held)
    statistics = fold_statistics(held, centers, gaps)
    shifted = FoldRows(held.rows.withColumns({g: F.col(g) - F.lit(centers[g]) for g in gaps}), held.features, held.target)
    medians = fold_medians(shifted, gaps) if gaps else None
    return centers, statistics, medians, [held.features.index(g) for g in gaps]


def normal_equations(held: FoldRows, alpha: float = 1.0) -> DataFrame:
    """Rows (factor, fold, feature_a, feature_b, gram, target_product): the ridge system of every fold.

    Both sides are of standardised columns; ``alpha`` is on the diagonal, ``target_product`` belongs to feature_a.
    """
    names = held.features
    _, statistics, medians, gap_at = _prepared(held)

    def make(normal: Normal):
        for a in normal.used.tolist():
            for b in normal.used.tolist():
                yield {"feature_a": names[a], "feature_b": names[b], "gram": float(normal.gram[a, b]) + (alpha if a == b else 0.0),
                       "target_product": float(normal.target[a])}

    return _normals(statistics, medians, make, "feature_a string, feature_b string, gram double, target_product double", len(names), gap_at)


def linear_forecast(held: FoldRows, solve: Solve) -> tuple[DataFrame, DataFrame]:
    """Predictions of all validation and test rows, and (factor, train_rows) summed over the folds."""
    features = held.features
    centers, statistics, medians, gap_at = _prepared(held)
    statistics = stage(statistics, "fold-statistics")

    def make(normal: Normal):
        weights = np.zeros(len(features))
        if len(normal.used):
            some = np.ix_(normal.used, normal.used)
            weights[normal.used] = solve(normal.gram[some], normal.target[normal.used], normal.rows) / normal.scale[normal.used]
        yield {"weights": weights.tolist(), "fill": normal.fill.tolist(), "base": float(normal.target_mean - weights @ normal.mean)}

    fits = _normals(statistics, medians, make, "weights array<double>, fill array<double>, base double", len(features), gap_at)
    fits = stage(fits, "fold-fits")
    values = F.array(*[F.col(f) - F.lit(centers[f]) for f in features]).cast("array<double>")
    terms = F.zip_with(F.zip_with(values, "fill", lambda x, m: F.coalesce(x, m)), "weights", lambda x, w: x * w)
    prediction: Column = F.col("base") + F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)
    fitted = evaluated(held).join(fits, [KEY, "fold"]).select(DATE, KEY, held.target, "role", "fold", prediction.alias("prediction"))
    return fitted, trained_rows(held)


def mean_forecast(held: FoldRows) -> tuple[DataFrame, DataFrame]:
    """The training mean of the target as forecast of all validation and test rows, and (factor, train_rows)."""
    blocks = held.rows.where("block < folds").groupBy(KEY, "block").agg(F.sum(held.target).alias("s"), F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy(KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means = blocks.select(KEY, F.col("block").alias("fold"), (F.sum("s").over(so_far) / F.sum("n").over(so_far)).alias("prediction"))
    fitted = evaluated(held).join(means, [KEY, "fold"])
    return fitted.select(DATE, KEY, held.target, "role", "fold", "prediction"), trained_rows(held)


def median_forecast(held: FoldRows) -> tuple[DataFrame, DataFrame]:
    """The training median of the target as forecast of all validation and test rows, and (factor, train_rows)."""
    medians = fold_medians(held, [held.target]).withColumn("prediction", F.get("medians", F.lit(0)))
    fitted = evaluated(held).join(medians, [KEY, "fold"])
    return fitted.select(DATE, KEY, held.target, "role", "fold", "prediction"), trained_rows(held)


def trained_rows(held: FoldRows) -> DataFrame:
    """Rows (factor, train_rows): over all folds, a row counting once for each fold it trains."""
    times = F.greatest(F.lit(0), F.col("folds") - F.col("block"))
    return held.rows.groupBy(KEY).agg(F.sum(times).cast("long").alias("train_rows"))
