"""Linear models of a panel from two passes: facts of the columns, then the products of all pairs of columns.

A task adds up its rows and passes on one small table, so nothing but sums is shuffled and no row is held in memory
between passes, however many steps the solver takes.  Products are taken from each column's mean on, which keeps them small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shipping import ship_package


@dataclass(frozen=True)
class SplitFacts:
    """Figures of one split; the arrays run over the features and count finite values, apart from ``filled``."""

    rows: int
    filled: np.ndarray  # values that are not missing
    finite: np.ndarray
    least: np.ndarray
    most: np.ndarray
    mean: np.ndarray

    def of(self, at: Sequence[int]) -> SplitFacts:
        """The facts of some of the features."""
        return SplitFacts(self.rows, self.filled[at], self.finite[at], self.least[at], self.most[at], self.mean[at])


@dataclass(frozen=True)
class LinearFit:
    """Weights of the standardised columns, with what standardises them."""

    weights: np.ndarray
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    base: float


def _matrix(batch, first: int, count: int) -> np.ndarray:
    """Columns of doubles, missing values as NaN."""
    if not count:
        return np.empty((batch.num_rows, 0))
    return np.column_stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(float) for k in range(count)])


def split_facts(rows: DataFrame, features: Sequence[str]) -> dict[str, SplitFacts]:
    """Facts by split of ``rows`` (split, features); one row for each split and feature comes to the driver."""
    features, count = list(features), len(features)

    def run(batches):
        for batch in batches:
            named = batch.column(0).dictionary_encode()
            codes = named.indices.to_numpy(zero_copy_only=False)
            x = _matrix(batch, 1, count)
            given = np.column_stack([batch.column(1 + k).is_valid().to_numpy(zero_copy_only=False) for k in range(count)])
            for code, split in enumerate(named.dictionary.to_pylist()):
                here = codes == code
                some, kind = (x, given) if len(named.dictionary) == 1 else (x[here], given[here])
                finite = np.isfinite(some)
                kept = some if finite.all() else np.where(finite, some, 0.0)
                yield pa.record_batch([
                    pa.array([split] * count, pa.string()), pa.array(np.arange(count, dtype=np.int32)), pa.array(np.full(count, here.sum())),
                    pa.array(kind.sum(axis=0)), pa.array(finite.sum(axis=0)), pa.array(kept.sum(axis=0)),
                    pa.array(np.where(finite, some, np.inf).min(axis=0)), pa.array(np.where(finite, some, -np.inf).max(axis=0)),
                ], ["split", "k", "rows", "filled", "finite", "total", "least", "most"])

    ship_package(rows.sparkSession)
    shape = "split string, k int, rows long, filled long, finite long, total double, least double, most double"
    told = rows.select("split", *features).mapInArrow(run, shape).groupBy("split", "k").agg(
        *[F.sum(c).alias(c) for c in ("rows", "filled", "finite", "total")], F.min("least").alias("least"), F.max("most").alias("most")
    )
    found: dict[str, list] = {}
    for r in told.orderBy("split", "k").collect():
        found.setdefault(r["split"], []).append(r)
    out = {}
    for split, rs in found.items():
        filled, finite, total, least, most = (np.array([r[c] for r in rs]) for c in ("filled", "finite", "total", "least", "most"))
        out[split] = SplitFacts(rs[0]["rows"], filled, finite, least, most, total / np.maximum(finite, 1))
    return out


def fit_linear(
    train: DataFrame, target: str, features: Sequence[str], fill: np.ndarray, facts: SplitFacts,
    solve: Callable[[np.ndarray, np.ndarray, float], np.ndarray],
) -> LinearFit:
    """Solve for the weights of the standardised features; missing values stand at ``fill``.

    ``facts`` are of the same rows and features.
    """
    features, count, center = list(features), len(features), facts.mean
    size = count + 2

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch, 1, count)
            z = np.column_stack([np.ones(len(x)), np.where(np.isnan(x), fill, x) - center, batch.column(0).to_numpy(zero_copy_only=False)])
            total += z.T @ z
        a, b = np.triu_indices(size)
        yield pa.record_batch([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["a", "b", "v"])

    ship_package(train.sparkSession)
    told = train.select(target, *features).mapInArrow(run, "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    whole = np.zeros((size, size))
    for r in told.collect():  # one row for each pair of columns
        whole[r["a"], r["b"]] = whole[r["b"], r["a"]] = r["v"]
    n = whole[0, 0]
    mean, target_mean = whole[0, 1:-1] / n, whole[0, -1] / n
    gram = whole[1:-1, 1:-1] - n * np.outer(mean, mean)
    right = whole[1:-1, -1] - n * mean * target_mean
    spread = np.sqrt(np.maximum(np.diag(gram), 0.0) / n)
    # a column whose values differ by rounding alone is constant: scaled up, its noise would be fitted
    moving = (facts.least < facts.most) & (spread > 10 * np.finfo(float).eps * np.maximum(1.0, np.abs(mean + center)))
    scale = np.where(moving, spread, 1.0)
    gram[~moving, :], gram[:, ~moving], right[~moving] = 0.0, 0.0, 0.0
    weights = solve(gram / np.outer(scale, scale), right / scale, n)
    return LinearFit(weights, fill, mean + center, scale, float(target_mean))


def predict_linear(rows: DataFrame, fitted: LinearFit, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """The columns of ``rows`` other than the features, and the prediction; equal rows get equal predictions."""
    features = list(features)
    others = [c for c in rows.columns if c not in features]

    def run(batches):
        for batch in batches:
            x = _matrix(batch, len(others), len(features))
            out = np.full(batch.num_rows, fitted.base)
            for k in range(len(features)):
                column = np.where(np.isnan(x[:, k]), fitted.fill[k], x[:, k])
                out += (column - fitted.mean[k]) / fitted.scale[k] * fitted.weights[k]
            yield pa.record_batch([*batch.columns[:len(others)], pa.array(out)], [*others, name])

    ship_package(rows.sparkSession)
    shape = T.StructType([*[rows.schema[c] for c in others], T.StructField(name, T.DoubleType())])
    return rows.select(*others, *features).mapInArrow(run, shape)
