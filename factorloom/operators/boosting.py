"""Leaf-wise gradient boosting on binned features.

A tree grows best first: of all leaves the one whose best cut lowers the squared error most is cut next, until the tree
has ``leaves`` leaves or no cut helps.  Cuts are found in histograms (rows and sum of residuals in each bin of each
feature).  A histogram is made for the smaller child of a cut only; the other is the parent's less that one.

On a panel the histograms are one aggregate over the whole table.  To ask for few of them, the children of all
leaves that may be cut are requested together, so a tree needs as many jobs as it is deep; children that are not
used in the end are forgotten.  The driver holds the trees and the histograms of one tree's leaves, whose size is given
by leaves, features and bins, not by rows.  Per-factor models have at most one row a date and are fitted inside grouped
tasks, one (factor, fold) each, by the same growth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.orderstats import pick_ranked
from ..plans.shipping import ship_package
from ..plans.staging import stage

#: Bins of a feature; bin 0 holds missing values.
MOST_BINS = 255


@dataclass(frozen=True)
class Settings:
    """Settings under the names of their meaning."""

    trees: int = 200
    rate: float = 0.05
    leaves: int = 31
    min_leaf: int = 20
    feature_share: float = 0.9
    seed: int = 42


Histogram = tuple[np.ndarray, np.ndarray]  # rows and sums of residuals: features x bins


@dataclass
class Node:
    path: tuple[tuple[int, int, bool], ...]  # (feature, bin, right): bins above the cut go right
    histogram: Histogram
    cut: tuple[float, int, int] | None = None  # gain, feature, bin
    children: tuple[Node, Node] | None = None

    @property
    def rows(self) -> float:
        return float(self.histogram[0][0].sum())

    @property
    def value(self) -> float:
        return float(self.histogram[1][0].sum() / max(self.rows, 1.0))


def best_cut(histogram: Histogram, features: Sequence[int], min_leaf: int) -> tuple[float, int, int] | None:
    """The cut with the largest fall of squared error, ties to the first feature and the lowest bin."""
    rows, sums = histogram[0][features], histogram[1][features]
    left, left_sum = rows.cumsum(axis=1)[:, :-1], sums.cumsum(axis=1)[:, :-1]
    right, right_sum = rows.sum(axis=1, keepdims=True) - left, sums.sum(axis=1, keepdims=True) - left_sum
    can = (left >= max(1, min_leaf)) & (right >= max(1, min_leaf)) & (rows[:, :-1] > 0)
    if not can.any():
        return None
    whole = sums[0].sum() ** 2 / rows[0].sum()
    gain = np.where(can, left_sum**2 / np.maximum(left, 1) + right_sum**2 / np.maximum(right, 1) - whole, -np.inf)
    # equal gains may differ in their last digits by the order of summation
    at = int(np.flatnonzero(gain.ravel() >= gain.max() - 1e-10 * abs(gain.max()))[0])
    feature, cut = divmod(at, gain.shape[1])
    best = float(gain[feature, cut])
    return (best, int(features[feature]), cut) if best > 1e-12 * max(whole, 1e-300) else None


def grow_tree(
    root: Histogram, histograms_of: Callable[[list[tuple]], list[Histogram]], features: Sequence[int], settings: Settings
) -> list[Node]:
    """Leaves of one tree; ``histograms_of`` gives the histograms of the rows on the given paths."""
    def made(path, histogram):
        return Node(path, histogram, best_cut(histogram, features, settings.min_leaf))

    leaves = [made((), root)]
    while len(leaves) < settings.leaves:
        can = [n for n in leaves if n.cut]
        if not can:
            break
        chosen = max(can, key=lambda n: n.cut[0])
        if chosen.children is None:
            asked = [n for n in can if n.children is None]
            smaller = []
            for n in asked:
                _, feature, cut = n.cut
                left = n.histogram[0][feature, : cut + 1].sum()
                smaller.append((*n.path, (feature, cut, bool(left > n.rows - left))))
            for n, path, found in zip(asked, smaller, histograms_of(smaller), strict=True):
                feature, cut, right = path[-1]
                other = (n.histogram[0] - found[0], n.histogram[1] - found[1])
                pair = (made(path, found), made((*n.path, (feature, cut, not right)), other))
                n.children = pair[::-1] if right else pair
        at = leaves.index(chosen)
        leaves[at: at + 1] = chosen.children
    return leaves


def on_path(bins: np.ndarray, path) -> np.ndarray:
    """Rows (of features in columns) that follow a path."""
    here = np.ones(len(bins), bool)
    for feature, cut, right in path:
        here &= (bins[:, feature] > cut) == right
    return here


def histogram(bins: np.ndarray, residual: np.ndarray, width: int) -> Histogram:
    count = bins.shape[1]
    flat = (bins + np.arange(count) * width).ravel()
    return (np.bincount(flat, minlength=count * width).astype(float).reshape(count, width),
            np.bincount(flat, np.repeat(residual, count), minlength=count * width).reshape(count, width))


@dataclass
class Boosted:
    """A fitted model: first value, trees as (path, value) lists, edges of the bins."""

    base: float
    rate: float
    edges: list[np.ndarray]
    trees: list[list[tuple[tuple, float]]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins from 1 on; values up to an edge are in its bin, missing ones in bin 0."""
        out = np.empty(x.shape, np.int64)
        for k, edges in enumerate(self.edges):
            column = x[:, k]
            out[:, k] = np.where(np.isnan(column), 0, np.searchsorted(edges, column) + 1)
        return out

    def raise_by(self, bins: np.ndarray, trees) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in trees:
            for path, value in tree:
                total[on_path(bins, path)] += self.rate * value
        return total

    def cuts(self) -> np.ndarray:
        """How often the trees cut by each feature."""
        made = {(number, path[:k], path[k][:2]) for number, tree in enumerate(self.trees) for path, _ in tree for k in range(len(path))}
        return np.bincount([cut[0] for *_, cut in made], minlength=len(self.edges))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.raise_by(self.binned(x), self.trees)


def _drawn(features: int, number: int, settings: Settings) -> np.ndarray:
    """Features of a tree, at least one."""
    size = max(1, int(round(features * settings.feature_share)))
    return np.sort(np.random.default_rng((settings.seed, number)).permutation(features)[:size])


def fit_rows(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Boosted:
    """Fit on rows in memory: one factor and fold."""
    edges = []
    for column in x.T:
        values = np.unique(column[~np.isnan(column)])
        if len(values) > MOST_BINS:
            values = values[(np.arange(1, MOST_BINS + 1) * len(values)) // MOST_BINS - 1]
        edges.append(values[:-1])  # the last bin is open
    model = Boosted(float(y.mean()), settings.rate, edges)
    bins, width = model.binned(x), max(len(e) for e in edges) + 2 if edges else 2
    fitted = np.full(len(y), model.base)
    for number in range(settings.trees if x.shape[1] else 0):
        residual = y - fitted
        made = lambda paths: [histogram(bins[m], residual[m], width) for m in (on_path(bins, p) for p in paths)]
        leaves = grow_tree(histogram(bins, residual, width), made, _drawn(x.shape[1], number, settings), settings)
        tree = [(n.path, n.value) for n in leaves]
        if len(tree) == 1 and settings.feature_share == 1:
            break  # no later tree can cut either
        model.trees.append(tree)
        fitted += model.raise_by(bins, [tree])
    return model


def boosted_fit(**settings) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Fit-and-predict function for the per-factor models."""
    held = Settings(**settings)
    return lambda x, y, new: fit_rows(x, y, held).predict(new)


def bin_edges(rows: DataFrame, features: Sequence[str], most: int = MOST_BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each feature: exact order statistics, at most ``most`` a feature."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f).cast("double").alias("v")) for k, f in enumerate(features)])
    ranks = {str(b): (lambda n, b=b: F.ceil(n * b / F.lit(most)).cast("long") - 1) for b in range(1, most)}
    picks = pick_ranked(stage(rows.select(F.inline(pairs)), "boosting-values"), ["feature"], "v", ranks)
    found: dict[int, set] = {}
    for row in picks.select("feature", "value").distinct().collect():  # at most ``most`` rows a feature
        found.setdefault(row["feature"], set()).add(row["value"])
    return [np.array(sorted(found.get(k, ())), float) for k in range(len(features))]


def fit_panel(train: DataFrame, features: Sequence[str], target: str, settings: Settings = Settings(), restage: int = 10) -> Boosted:
    """Fit on a whole table; rows without target are left out.

    ``restage`` trees are applied on the fly before the residuals are written again.
    """
    ship_package(train.sparkSession)
    features = list(features)
    rows = stage(train.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]), "boosting-rows")
    base = rows.agg(F.avg("y")).first()[0]
    if base is None:
        raise ValueError("no row to fit on")
    model = Boosted(float(base), settings.rate, bin_edges(rows, features))
    width = max(len(e) for e in model.edges) + 2
    count = len(features)

    def pack(batches):
        for batch in batches:
            x = np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(count)])
            residual = batch.column(0).to_numpy(zero_copy_only=False) - model.base
            yield pa.record_batch([pa.array([model.binned(x).astype(np.uint8 if width <= 256 else np.uint16).tobytes()]), pa.array([residual.tobytes()])], ["bins", "residual"])

    kind = np.uint8 if width <= 256 else np.uint16
    shape = "bins binary, residual binary"
    packed = stage(rows.mapInArrow(pack, shape), "boosting-bins")
    fresh: list = []

    def read(batch, at, trees):
        bins = np.frombuffer(batch.column(0)[at].as_buffer(), kind).reshape(-1, count).astype(np.int64)
        return bins, np.frombuffer(batch.column(1)[at].as_buffer(), np.float64) - model.raise_by(bins, trees)

    def histograms_of(paths):
        trees = list(fresh)

        def tally(batches):
            totals = [(np.zeros((count, width)), np.zeros((count, width))) for _ in paths]
            for batch in batches:
                for at in range(batch.num_rows):
                    bins, residual = read(batch, at, trees)
                    for total, path in zip(totals, paths, strict=True):
                        here = on_path(bins, path)
                        n, s = histogram(bins[here], residual[here], width)
                        total[0][:] += n
                        total[1][:] += s
            yield pa.record_batch([pa.array(np.arange(len(paths), dtype=np.int32)), pa.array([np.stack(t).tobytes() for t in totals])], ["path", "packed"])

        def add(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for path, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    values = np.frombuffer(one.as_buffer(), np.float64)
                    totals[path] = totals[path] + values if path in totals else values
            if totals:
                yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()])], ["path", "packed"])

        kinds = "path int, packed binary"
        told = packed.mapInArrow(tally, kinds)
        found: dict[int, np.ndarray] = {}
        for row in told.repartition(min(len(paths), 32), "path").mapInArrow(add, kinds).collect():  # one row a path
            found[row["path"]] = np.frombuffer(row["packed"], np.float64).reshape(2, count, width)
        return [(found[k][0], found[k][1]) for k in range(len(paths))]

    for number in range(settings.trees):
        if len(fresh) >= restage:
            trees = list(fresh)

            def settle(batches, trees=trees):
                for batch in batches:
                    for at in range(batch.num_rows):
                        yield pa.record_batch([batch.column(0).slice(at, 1), pa.array([read(batch, at, trees)[1].tobytes()])], ["bins", "residual"])

            packed = stage(packed.mapInArrow(settle, shape), "boosting-bins")
            fresh.clear()
        leaves = grow_tree(histograms_of([()])[0], histograms_of, _drawn(count, number, settings), settings)
        tree = [(n.path, n.value) for n in leaves]
        model.trees.append(tree)
        fresh.append(tree)
    return model


def predict_panel(rows: DataFrame, model: Boosted, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """All rows and columns with the model's prediction."""
    ship_package(rows.sparkSession)
    at = [rows.columns.index(f) for f in features]
    shared = rows.sparkSession.sparkContext.broadcast(model)  # its size is given by trees and leaves

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in at])
            yield pa.record_batch([*batch.columns, pa.array(shared.value.predict(x))], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))
