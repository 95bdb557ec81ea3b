"""Splits, folds and models.

Per-factor models see one row per date, so a group is bounded by the calendar; it is fitted
with a few lines of numpy inside grouped tasks, and the number of groups (factors, folds,
settings) is what Spark spreads.  Linear panel models are solved from sums over the
whole panel, its trees grow in MLlib.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import guarded_correlation
from ..plans.orderstats import pick_ranked
from ..plans.shipping import ship_package
from ..plans.staging import fixed_table, stage
from . import boosting as W
from . import folds as FD
from . import metrics as M
from . import panelfit as PF
from . import trees as TR

TARGET = "factor_long_short_ret_1m"

# --- splits ----------------------------------------------------------------------------


def chronological_split(
    dates: DataFrame, *, validation_fraction: float = 0.2, holdout_fraction: float = 0.2, min_train_periods: int = 1,
    column: str = "formation_date",
) -> DataFrame:
    """(date, split) for the distinct dates, oldest first: train, validation, holdout."""
    for value, what in ((validation_fraction, "validation"), (holdout_fraction, "holdout")):
        if not 0.0 < value < 1.0:
            raise ValueError(f"{what} fraction must lie between 0 and 1")
    if validation_fraction + holdout_fraction >= 1.0:
        raise ValueError("validation and holdout fractions must sum to less than 1")
    if min_train_periods < 1:
        raise ValueError("at least one training period is needed")
    distinct = stage(dates.where(F.col(column).isNotNull()).select(column).distinct(), "dates")
    n = distinct.count()
    if n < min_train_periods + 2:
        raise ValueError("too few periods for train, validation and holdout")
    # round() is half to even, as the split rule wants
    holdout = max(1, round(n * holdout_fraction))
    validation = max(1, round(n * validation_fraction))
    excess = holdout + validation - (n - min_train_periods)
    if excess > 0:
        validation = max(1, validation - excess)
    train = n - holdout - validation
    if train < min_train_periods:
        raise ValueError("too few training periods after the split")
    position = F.row_number().over(Window.orderBy(column))
    split = F.when(position <= train, "train").when(position <= train + validation, "validation").otherwise("holdout")
    return distinct.select(column, split.alias("split"))


def _dated(returns: DataFrame, min_observations: int) -> DataFrame:
    """Rows with a return, their 0-based date position and the row count of their factor."""
    by_factor = Window.partitionBy("factor_id")
    rows = returns.where(F.col(TARGET).isNotNull())
    rows = rows.withColumns(
        {"i": F.row_number().over(by_factor.orderBy("formation_date")) - 1, "n": F.count(F.lit(1)).over(by_factor)}
    )
    return rows.where(F.col("n") >= min_observations)


def holdout_split(
    returns: DataFrame, *, validation_fraction: float = 0.15, holdout_fraction: float = 0.15, min_observations: int = 24,
) -> DataFrame:
    """One fold per factor: returns with role and fold columns."""
    rows = _dated(returns, max(6, min_observations))
    n = F.col("n")
    holdout = F.greatest(F.lit(1), F.bround(n * F.lit(float(holdout_fraction))).cast("int"))
    validation = F.greatest(F.lit(1), F.bround(n * F.lit(float(validation_fraction))).cast("int"))
    train = F.greatest(F.lit(1), n - holdout - validation)
    role = F.when(F.col("i") < train, "train").when(F.col("i") < train + validation, "validation").otherwise("holdout")
    return rows.withColumns({"fold": F.lit(0), "role": role}).drop("i", "n")


def walk_forward_folds(
    returns: DataFrame, *, min_observations: int = 24, validation_periods: int = 12, test_periods: int = 12
) -> DataFrame:
    """Expanding folds: every row once per fold it takes part in, with role and fold number.

    A fold tests ``test_periods`` dates, validates on the dates before them and trains on all
    earlier dates.  The folds of a row follow from its position, so nothing is joined.
    """
    step = max(1, test_periods)
    ahead = max(0, validation_periods)
    first = min_observations + ahead
    rows = _dated(returns, min_observations)
    starts = F.when(F.col("n") > first, F.sequence(F.lit(first), F.col("n").cast("int") - 1, F.lit(step)))
    mine = F.filter(starts, lambda s: F.col("i") < s + step)
    rows = rows.select("*", F.explode(mine).alias("start"))
    valid_from = F.greatest(F.lit(min_observations), F.col("start") - ahead)
    role = F.when(F.col("i") >= F.col("start"), "holdout").when(F.col("i") >= valid_from, "validation").otherwise("train")
    fold = ((F.col("start") - first) / step).cast("int")
    return rows.withColumns({"fold": fold, "role": role}).drop("i", "n", "start")


# --- per-factor fits -------------------------------------------------------------------

FitPredict = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _standardized(train: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns with values, gaps at the training median, scaled by the training moments."""
    keep = ~np.all(np.isnan(train), axis=0)
    train, other = train[:, keep], other[:, keep]
    if not train.shape[1]:
        return train, other
    median = np.nanmedian(train, axis=0)
    train = np.where(np.isnan(train), median, train)
    other = np.where(np.isnan(other), median, other)
    center, scale = train.mean(axis=0), train.std(axis=0)
    scale = np.where(scale > 10 * np.finfo(float).eps * np.maximum(1.0, np.abs(center)), scale, 1.0)
    return (train - center) / scale, (other - center) / scale


def ridge_weights(alpha: float = 1.0) -> FD.Solve:
    return lambda gram, target, n: np.linalg.solve(gram + alpha * np.eye(len(target)), target)


def elastic_net_weights(alpha: float = 0.001, l1_ratio: float = 0.5, max_iter: int = 2000, tol: float = 1e-10) -> FD.Solve:
    """Cyclic coordinate descent on (1/2n)|y-Xw|^2 + alpha*(l1_ratio*|w| + (1-l1_ratio)/2*|w|^2)."""

    def solve(gram, target, n):
        gram, target, p = gram / n, target / n, len(target)
        w = np.zeros(p)
        for _ in range(max_iter):
            largest = 0.0
            for j in range(p):
                pull = target[j] - gram[j] @ w + gram[j, j] * w[j]
                size = max(abs(pull) - alpha * l1_ratio, 0.0) / (gram[j, j] + alpha * (1 - l1_ratio))
                value = np.sign(pull) * size
                largest = max(largest, abs(value - w[j]))
                w[j] = value
            if largest < tol:
                break
        return w

    return solve


def _fit_by(solve: FD.Solve) -> FitPredict:
    def fit(x, y, new):
        x, new = _standardized(x, new)
        return y.mean() + new @ solve(x.T @ x, x.T @ (y - y.mean()), len(x))

    return fit


def ridge_fit(alpha: float = 1.0) -> FitPredict:
    return _fit_by(ridge_weights(alpha))


def elastic_net_fit(alpha: float = 0.001, l1_ratio: float = 0.5, max_iter: int = 2000, tol: float = 1e-10) -> FitPredict:
    return _fit_by(elastic_net_weights(alpha, l1_ratio, max_iter, tol))


FACTOR_MODELS: dict[str, Callable[..., FD.Solve]] = {
    "baseline_linear": ridge_weights, "ridge": ridge_weights, "elasticnet": elastic_net_weights,
}
CONSTANT_MODELS = ("baseline_mean", "baseline_median")
# Leaf-wise boosting with the settings that the study's headline model has: 200 trees of 31 leaves at a rate of 0.05.
LEAFWISE_MODELS = ("lightgbm", "leafwise_boosting")
FACTOR_FORESTS = {
    "random_forest": {"bootstrap": True, "random_cuts": False}, "extra_trees": {"bootstrap": False, "random_cuts": True},
    "extratrees": {"bootstrap": False, "random_cuts": True},
}


@dataclass(frozen=True)
class FactorForecast:
    predictions: DataFrame
    metrics: DataFrame


_FIT_SCHEMA = f"formation_date date, factor_id string, {TARGET} double, role string, fold int, prediction double"


def _grouped_fit(rows: DataFrame, features: Sequence[str], fit: FitPredict) -> DataFrame:
    """Fit on the training rows of each (factor, fold), predict all its rows."""
    features = list(features)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        train = pdf["role"] == "train"
        out = pdf[["formation_date", "factor_id", TARGET, "role", "fold"]].copy()
        x = pdf[features].to_numpy(dtype=float)
        y = pdf[TARGET].to_numpy(dtype=float)
        out["prediction"] = fit(x[train], y[train], x) if train.any() else np.nan
        return out

    ship_package(rows.sparkSession)
    columns = ["formation_date", "factor_id", TARGET, "role", "fold", *features]
    # a given number of partitions stays: by their bytes alone all groups would be merged into one task
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.select(*columns).repartition(parts, "factor_id", "fold").groupBy("factor_id", "fold").applyInPandas(one, _FIT_SCHEMA)


def train_factor_models(
    returns: DataFrame, macro: DataFrame, *, model: str | FitPredict = "ridge", model_params: dict | None = None,
    evaluation_mode: str = "walk_forward", min_observations: int = 24, validation_fraction: float = 0.15,
    holdout_fraction: float = 0.15, walk_forward_test_periods: int = 12, walk_forward_validation_periods: int = 12,
) -> FactorForecast:
    """Forecast each factor's next return from the macro features of the date.

    ``model`` is a name or any fit-and-predict function.  Linear models, mean and median
    are fitted on all folds from running sums; only other models see a copy of each fold.  Factors with too few rows are left
    out.  Walk-forward predictions are those of the test dates, with the first test date of
    their fold; in the single-holdout mode all three splits are predicted.
    """
    frame = returns.join(macro, "formation_date")
    name = model if isinstance(model, str) else getattr(model, "__name__", "custom")
    features = [c for c in macro.columns if c != "formation_date"]
    if evaluation_mode == "walk_forward" and isinstance(model, str) and name in (*FACTOR_MODELS, *CONSTANT_MODELS, *FACTOR_FORESTS):
        held = FD.fold_rows(
            stage(frame, "fold-rows"), [] if name in CONSTANT_MODELS else features, TARGET, min_observations=min_observations,
            validation_periods=walk_forward_validation_periods, test_periods=walk_forward_test_periods,
        )
        if name in CONSTANT_MODELS:
            fitted, train_rows = (FD.mean_forecast if name == "baseline_mean" else FD.median_forecast)(held)
        elif name in FACTOR_FORESTS:
            fitted, train_rows = TR.forest_forecast(held, **FACTOR_FORESTS[name], **(model_params or {}))
        else:
            fitted, train_rows = FD.linear_forecast(held, FACTOR_MODELS[name](**(model_params or {})))
        return _walk_forward_result(stage(fitted, "fitted"), name, train_rows)
    if evaluation_mode == "walk_forward":
        rows = walk_forward_folds(
            frame, min_observations=min_observations, validation_periods=walk_forward_validation_periods,
            test_periods=walk_forward_test_periods,
        )
    elif evaluation_mode == "single_holdout":
        rows = holdout_split(frame, validation_fraction=validation_fraction, holdout_fraction=holdout_fraction,
                             min_observations=min_observations)
    else:
        raise ValueError(f"unknown evaluation mode: {evaluation_mode}")
    if name in CONSTANT_MODELS:
        center = F.avg(TARGET) if name == "baseline_mean" else F.median(TARGET)
        constants = rows.where("role = 'train'").groupBy("factor_id", "fold").agg(
            F.coalesce(center, F.lit(0.0)).alias("prediction")
        )
        fitted = rows.join(constants, ["factor_id", "fold"])
    elif name == "baseline_random":
        fitted = rows.withColumn("prediction", random_score("factor_id", "formation_date"))
    elif callable(model):
        fitted = _grouped_fit(rows, features, model)
    elif name in LEAFWISE_MODELS:
        fitted = _grouped_fit(rows, features, W.boosted_fit(**(model_params or {})))
    elif name in FACTOR_MODELS:
        fitted = _grouped_fit(rows, features, _fit_by(FACTOR_MODELS[name](**(model_params or {}))))
    else:
        raise KeyError(f"unknown model {name}; known: {', '.join(available_models())}")
    fitted = stage(fitted.select("formation_date", "factor_id", TARGET, "role", "fold", "prediction"), "fitted")
    if evaluation_mode == "walk_forward":
        return _walk_forward_result(fitted, name)
    predictions = fitted.withColumnsRenamed({"role": "split"}).withColumn("model", F.lit(name))
    return FactorForecast(predictions.drop("fold"), factor_model_metrics(fitted, name, evaluation_mode))


def _walk_forward_result(fitted: DataFrame, name: str, train_rows: DataFrame | None = None) -> FactorForecast:
    """The test rows with the first test date of their fold; ``train_rows`` stands in for training rows not among ``fitted``."""
    first = F.min("formation_date").over(Window.partitionBy("factor_id", "fold"))
    predictions = fitted.withColumnsRenamed({"role": "split"}).withColumn("model", F.lit(name))
    predictions = predictions.where("split = 'holdout'").withColumn("fold_start", first).drop("fold")
    found = factor_model_metrics(fitted, name, "walk_forward")
    if train_rows is not None:
        columns = found.columns
        found = found.drop("train_rows").join(train_rows, "factor_id").select(*columns)
    return FactorForecast(predictions, found)


def random_score(*keys: str, seed: int = 42):
    """A repeatable normal score per key, from two hashes (Box-Muller)."""
    def uniform(salt: int):
        return (F.pmod(F.xxhash64(F.lit(seed + salt), *keys), F.lit(2**53)) + 1) / F.lit(float(2**53 + 1))

    return F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * np.pi * uniform(1))


def factor_model_metrics(fitted: DataFrame, model: str, mode: str) -> DataFrame:
    """Row counts, pooled rank correlation and absolute error per factor.

    The rows of a factor and role are bounded by dates and folds, so plain windows rank them."""
    def rank(column: str):
        tied = F.count(F.lit(1)).over(Window.partitionBy("factor_id", "role", column))
        return F.rank().over(Window.partitionBy("factor_id", "role").orderBy(column)) + (tied - 1) / 2

    ranked = fitted.withColumns({"rank_y": rank(TARGET), "rank_p": rank("prediction")})

    def role(name: str, value):
        return F.when(F.col("role") == name, value)

    sums = [F.count_distinct("fold").alias("fold_count")]
    for name in ("train", "validation", "holdout"):
        sums.append(F.count_if(F.col("role") == name).alias(f"{name}_rows"))
    for name in ("validation", "holdout"):
        sums.append(
            guarded_correlation(role(name, F.col("rank_p")), role(name, F.col("rank_y"))).alias(f"{name}_correlation")
        )
        sums.append(F.avg(role(name, F.abs(F.col("prediction") - F.col(TARGET)))).alias(f"{name}_mae"))
    return ranked.groupBy("factor_id").agg(*sums).withColumns(
        {"model": F.lit(model), "evaluation_mode": F.lit(mode)}
    )


# --- panel models ----------------------------------------------------------------------

# Columns that never enter a feature matrix.
EXCLUDED_FEATURES = (
    "permno", "permco", "formation_date", "forward_return_start", "forward_return_end", "ret_1m_fwd", "ret_3m_fwd",
    "ret_6m_fwd", "forward_return_end_3m", "forward_return_end_6m", "universe_source", "label_source",
)


def numeric_features(df: DataFrame, target: str) -> list[str]:
    """Every numeric column but keys, labels and the target."""
    excluded = {*EXCLUDED_FEATURES, target}
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded]
    if not found:
        raise ValueError("no numeric feature column")
    return found


def available_models() -> list[str]:
    return sorted({*FACTOR_MODELS, *CONSTANT_MODELS, *FACTOR_FORESTS, *LEAFWISE_MODELS, *PANEL_MODELS, "baseline_random"})


PANEL_MODELS = ("baseline_linear", "ridge", "elasticnet", "random_forest", "boosting")
_LINEAR = ("baseline_linear", "ridge", "elasticnet")


def _estimator(name: str, params: dict, *_figures):
    common = {"featuresCol": "features", "labelCol": "_y", "predictionCol": "prediction"}
    if name == "random_forest":
        settings = {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 20, "seed": 42, **params}
        return RandomForestRegressor(**settings, **common)
    if name == "boosting":
        settings = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.9, "seed": 42, **params}
        return GBTRegressor(**settings, **common)
    raise KeyError(f"unknown model {name}; known: {', '.join(available_models())}")


@dataclass(frozen=True)
class PanelEvaluation:
    predictions: DataFrame
    metrics: DataFrame
    importance: DataFrame
    splits: DataFrame


def _train_medians(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact median of each feature over the training rows; all-missing features are absent."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    picks = pick_ranked(
        train.select(F.inline(pairs)), ["feature"], "v",
        {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2)},
    )
    # one row per feature: as many as there are columns
    return {r["feature"]: r["m"] for r in picks.groupBy("feature").agg(F.avg("value").alias("m")).collect()}


def evaluate_panel_model(
    panel: DataFrame, *, model: str = "ridge", target: str = "ret_1m_fwd", features: Sequence[str] | None = None,
    params: dict | None = None, validation_fraction: float = 0.2, holdout_fraction: float = 0.2,
    splits: DataFrame | None = None, run_id: str = "run",
) -> PanelEvaluation:
    """Fit on the training dates only, predict and measure all three splits.

    The panel is read several times; pass a staged table if it is costly to compute.
    """
    params = dict(params or {})
    features = list(features) if features is not None else numeric_features(panel, target)
    rows = panel.dropna(subset=[target, "formation_date"])
    splits = splits if splits is not None else chronological_split(
        rows, validation_fraction=validation_fraction, holdout_fraction=holdout_fraction
    )
    y = F.col(target).cast("double")
    splits = stage(splits, "splits")
    rows = rows.join(splits, "formation_date").select(
        "split", "permno", "formation_date", y.alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]
    )
    train = rows.where("split = 'train'")
    facts = PF.split_facts(rows, features)
    keys = ["split", "permno", "formation_date", "_y"]
    fitted, usable = None, []
    if model in CONSTANT_MODELS:
        wanted = F.avg("_y") if model == "baseline_mean" else None
        value = train.agg(wanted).first()[0] if wanted is not None else _train_medians(train, ["_y"]).get("_y")
        if value is None:
            raise ValueError("the training split is empty")
        scored = rows.withColumn("prediction", F.lit(float(value)))
    elif model == "baseline_random":
        scored = rows.withColumn("prediction", random_score("permno", "formation_date"))
    elif model in LEAFWISE_MODELS:
        if "train" not in facts:
            raise ValueError("the training split is empty")
        fitted, usable = W.fit_panel(train, features, "_y", W.Settings(**params)), features
        scored = W.predict_panel(rows, fitted, features)
    else:
        if "train" not in facts:
            raise ValueError("the training split is empty")
        at = [k for k in range(len(features)) if facts["train"].finite[k]]
        usable = [features[k] for k in at]
        # a column without gaps needs no median
        gaps = [features[k] for k in at if any(found.filled[k] < found.rows for found in facts.values())]
        medians = _train_medians(train, gaps) if gaps else {}
        if model in _LINEAR:
            odd = [features[k] for k in at if any(found.finite[k] < found.filled[k] for found in facts.values())]
            if odd:
                raise ValueError(f"values that are not finite: {', '.join(odd)}")
            fill = np.array([medians.get(f, 0.0) for f in usable])
            fitted = PF.fit_linear(train, "_y", usable, fill, facts["train"].of(at), FACTOR_MODELS[model](**params))
            scored = PF.predict_linear(rows.select(*keys, *usable), fitted, usable)
        else:
            filled = [(F.coalesce(F.col(f), F.lit(medians[f])) if f in medians else F.col(f)).alias(f"x|{f}") for f in usable]
            ready = rows.select(*keys, *filled)
            pipeline = Pipeline(stages=[
                VectorAssembler(inputCols=[f"x|{f}" for f in usable], outputCol="features"), _estimator(model, params),
            ])
            fitted = pipeline.fit(ready.where("split = 'train'"))
            scored = fitted.transform(ready)
    scored = stage(
        scored.select("split", F.col("permno").alias("id"), F.col("formation_date").alias("period"),
                      F.col("_y").alias("actual"), "prediction"), "panel_scored",
    )
    coverage = fixed_table(
        panel.sparkSession, [(split, float(sum(found.filled / found.rows) / len(features))) for split, found in facts.items()],
        "split string, feature_coverage double",
    )
    return PanelEvaluation(
        predictions=scored.select("split", F.col("id").alias("permno"), F.col("period").alias("formation_date"),
                                  "actual", "prediction"),
        metrics=M.evaluate_predictions(scored, ["split"], coverage=coverage).withColumn("model", F.lit(model)),
        importance=feature_importance(panel.sparkSession, fitted, usable, features, run_id),
        splits=splits,
    )


def feature_importance(
    spark: SparkSession, fitted, usable: Sequence[str], features: Sequence[str], run_id: str
) -> DataFrame:
    """Tree importances or absolute coefficients; one row per feature, missing if unused."""
    values: dict[str, float] = {}
    if isinstance(fitted, W.Boosted):
        values = {f: float(n) for f, n in zip(usable, fitted.cuts(), strict=True)}
    elif isinstance(fitted, PF.LinearFit):
        values = {f: float(abs(w)) for f, w in zip(usable, fitted.weights, strict=True)}
    elif fitted is not None:
        vector = fitted.stages[-1].featureImportances.toArray()
        values = {f: float(v) for f, v in zip(usable, vector, strict=True)}
    kind = "model" if fitted is not None else "unavailable"
    rows = [(f, values.get(f), kind, run_id) for f in features]
    return fixed_table(spark, rows, "feature string, importance double, importance_type string, run_id string")


def published_predictions(predictions: DataFrame, run_id: str) -> DataFrame:
    """Column names of the stored run artefact."""
    return predictions.select(
        F.lit(run_id).alias("run_id"), F.col("formation_date").alias("date"), F.col("permno").alias("asset_id"),
        "prediction", F.col("actual").alias("target_return"), "split",
    )


# --- period runs -----------------------------------------------------------------------

def period_runs(rows: DataFrame, *, order: str, period: str, by: Sequence[str] = ()) -> DataFrame:
    """Lengths of runs of equal neighbouring periods; a period with two runs is an error.

    A period's rows are contiguous exactly if no other period begins inside its span, so the
    check needs one aggregate per period and a window over periods only.
    """
    keys = list(by)
    spans = rows.groupBy(*keys, period).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("size")
    )
    spans = stage(spans, "spans")
    in_order = Window.partitionBy(*keys).orderBy("first")
    overlap = F.lead("first").over(in_order) <= F.col("last")
    broken = spans.withColumn("broken", overlap).where("broken").limit(1).count()
    if broken:
        raise ValueError("period labels are not contiguous")
    return spans.withColumn("run", F.row_number().over(in_order)).select(*keys, "run", period, "size")
