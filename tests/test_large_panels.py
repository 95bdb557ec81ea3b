"""The study's score surface and the panel models over tables that are large beside their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import factors as G
from factorloom.operators import models as L
from factorloom.operators import portfolio as B
from factorloom.operators import scoresweep as SW
from factorloom.operators import study as Y
from factorloom.plans.staging import stage
from tests.test_factors import synthetic
from tests.test_metrics_models import panel_frame


@pytest.fixture(scope="module")
def surface(spark):
    rows = synthetic(6, 40)
    panel = stage(spark.createDataFrame(rows).withColumn("ret_1m_fwd", F.when(F.col("permno") % 7 != 3, F.col("ret_1m_fwd"))), "panel")
    signals = stage(G.signal_scores(panel).where("permno % 5 <> 0 OR signal > 'm'"), "signals")
    registry = stage(G.registry_frame(spark, G.COMPUTABLE).select("factor_id", "signal"), "registry")
    dates = panel.select("formation_date").distinct()
    split = F.explode(F.array(*[F.lit(s) for s in "abc"])).alias("split")
    weights = dates.crossJoin(registry).select("formation_date", "factor_id", split)
    weight = F.when(F.col("split") == "a", 1.0).when(F.col("split") == "b", F.pmod(F.hash("factor_id"), F.lit(7)) / 7.0)
    weights = stage(weights.withColumn("weight", weight.otherwise(F.lit(0.5))), "weights")
    # split c has a single factor and a date without any
    one = registry.agg(F.max("factor_id")).first()[0]
    first = panel.agg(F.min("formation_date")).first()[0]
    weights = weights.where((F.col("split") != "c") | ((F.col("factor_id") == one) & (F.col("formation_date") > first)))
    return panel, signals, registry, stage(weights, "weights")


def test_scores_of_all_splits_give_the_same_returns(surface):
    panel, signals, registry, weights = surface
    scored = B.stock_scores_from_signals(weights, signals, registry)
    want = B.qspread_portfolio(B.qspread_members(scored, panel), by_split=True)
    names = list(dict.fromkeys(f.signal for f in G.COMPUTABLE))
    got = SW.qspread_returns(weights, signals, registry, panel, names)
    found = {(r.formation_date, r.split): r.portfolio_return for r in got.collect()}
    wanted = {(r.formation_date, r.split): r.portfolio_return for r in want.collect()}
    assert set(found) == set(wanted) and len({s for _, s in found}) == 3
    for key, value in wanted.items():
        assert found[key] == pytest.approx(value, abs=1e-12), key


def test_cells_keep_the_order_of_doubles():
    values = np.sort(np.concatenate([np.random.default_rng(3).normal(size=500), [-0.0, 0.0, 1e-300, -1e-300, 5.0, -5.0]]))
    cells = SW.score_cells(values)
    assert (np.diff(cells) >= 0).all() and len(np.unique(cells)) > 100
    assert SW.score_cells(np.array([-0.0]))[0] == SW.score_cells(np.array([0.0]))[0]


def test_study_makes_no_row_for_each_security_date_and_split(monkeypatch, spark):
    labels = []

    def noted(df, label, *args, **options):
        labels.append(label)
        return stage(df, label, *args, **options)

    monkeypatch.setattr(B, "stage", noted)
    panel = stage(spark.createDataFrame(synthetic(40, 12)), "panel")
    signals = stage(G.signal_scores(panel), "signals")
    returns = stage(G.panel_factor_returns(panel, quantiles=(0.2,)), "returns")
    axes = Y.runnable_axes(panel.columns) | {
        "quantile": ("0.20",), "model": ("baseline_mean",), "min_weight": ("0.0",), "portfolio_surface": ("stock_score_qspread",),
    }
    study = Y.grid_study(panel, returns, signals, axes=axes)
    assert study.count() == 2 and "qspread_rows" not in labels


@pytest.mark.parametrize("model", ["ridge", "elasticnet"])
def test_panel_models_write_no_features(spark, monkeypatch, model):
    df = stage(panel_frame(spark), "frame")
    written = {}

    def noted(df, label, *args, **options):
        written[label] = df.columns
        return stage(df, label, *args, **options)

    monkeypatch.setattr(L, "stage", noted)
    out = L.evaluate_panel_model(df, model=model)
    assert "panel_rows" not in written and written["panel_scored"] == ["split", "id", "period", "actual", "prediction"]
    coverage = {r.split: r.feature_coverage for r in out.metrics.collect()}
    want = df.join(out.splits, "formation_date").groupBy("split").agg(
        ((F.count("a") + F.count("b") + F.count("none") + F.count("same")) / F.count(F.lit(1)) / 4).alias("c")
    )
    assert coverage == pytest.approx({r.split: r.c for r in want.collect()})


def test_medians_are_taken_of_columns_with_gaps_only(spark, monkeypatch):
    asked = []
    medians = L._train_medians
    monkeypatch.setattr(L, "_train_medians", lambda train, features: asked.extend(features) or medians(train, features))
    L.evaluate_panel_model(stage(panel_frame(spark), "frame"), model="ridge")
    assert asked == ["b"]


def test_values_that_are_not_finite_are_refused(spark):
    df = stage(panel_frame(spark).withColumn("a", F.when(F.col("permno") == 3, float("inf")).otherwise(F.col("a"))), "frame")
    with pytest.raises(ValueError, match="not finite: a"):
        L.evaluate_panel_model(df, model="ridge")


def test_rounding_noise_of_a_constant_column_is_not_fitted(spark):
    noisy = F.when(F.col("permno") % 2 == 0, F.lit(np.nextafter(10.0, 11.0))).otherwise(F.lit(10.0))
    target = F.col("ret_1m_fwd") + (F.col("permno") % 2)
    df = stage(panel_frame(spark).withColumns({"same": noisy, "ret_1m_fwd": target}), "frame")
    importance = {r.feature: r.importance for r in L.evaluate_panel_model(df, model="ridge").importance.collect()}
    assert importance["same"] == pytest.approx(0, abs=1e-9) and importance["a"] > 0
