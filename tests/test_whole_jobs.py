"""Registered queries do the whole job: no smaller fit, no left-out axis."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from factorloom.catalog import queries as Q
from factorloom.catalog.queries import STUDIES
from factorloom.operators import factors as G
from factorloom.operators import models as L
from factorloom.operators import portfolio as B
from factorloom.operators import study as Y
from factorloom.plans.staging import stage
from factorloom.sources import market_tables as T
from tests.conftest import rows_of
from tests.test_factors import synthetic

SF = "/root/testdata/sf0.001"


def test_boosting_query_fits_all_trees(spark, monkeypatch):
    asked = {}

    def evaluate(panel, *, model, params):
        asked.update(model=model, params=params)
        return SimpleNamespace(metrics=None)

    monkeypatch.setattr(Q, "_feature_panel", lambda spark, sf: None)
    monkeypatch.setattr(L, "evaluate_panel_model", evaluate)
    Q.panel_boosting_eval(spark, "anywhere")
    assert asked["model"] == "boosting"
    assert L._estimator("boosting", asked["params"], 1, 1.0).getMaxIter() == 200


@pytest.fixture(scope="module")
def studied(spark):
    rows = spark.createDataFrame(synthetic(40, 24))
    panel = stage(rows.withColumns({"macro__sp500": F.col("macro__b") + 1, "macro__sp500_m1": -F.col("macro__a")}), "panel")
    signals = stage(G.signal_scores(panel, carry=["ret_1m_fwd"]), "signals")
    quantiles = tuple(float(q) for q in G.GRID_AXES["quantile"])
    returns = stage(G.panel_factor_returns(panel, quantiles=quantiles), "returns")
    return panel, returns, signals, stage(Y.grid_study(panel, returns, signals), "study")


def test_study_has_every_runnable_combination(spark, studied):
    panel, _, _, study = studied
    grid = G.parameter_grid(spark)
    assert rows_of(study.select("variant", *G.GRID_AXES)) == rows_of(grid)
    assert study.count() == 4 * 4 * 3 * 2 * 3 * 2
    few = Y.runnable_axes(["macro__a"])
    assert few["macro_feature_design"] == ("current_macro_family",) and few["model"] == G.GRID_AXES["model"]
    assert "parameter_grid_study" in STUDIES


@pytest.mark.parametrize("model,floor,universe,design,surface", [
    ("ridge", "0.03", "selected_13_global_local", "us_macro_25x3", "weighted_factor_return"),
    ("elasticnet", "0.01", "all_implemented_current", "us_macro_expanded", "stock_score_qspread"),
    ("lightgbm", "0.01", "all_implemented_current", "us_macro_25x3", "weighted_factor_return"),
    ("baseline_mean", "0.0", "selected_13_global_local", "current_macro_family", "stock_score_qspread"),
])
def test_study_equals_a_single_run(studied, model, floor, universe, design, surface):
    panel, returns, signals, study = studied
    one = returns.where("quantile = 0.15")
    macro = stage(G.macro_design(panel, design), "macro")
    members = G.select_universe(one, macro, universe=universe).select("factor_id")
    one = stage(one.join(members, "factor_id"), "one")
    forecast = L.train_factor_models(one, macro, model=model).predictions
    weights = B.factor_allocations(forecast, min_weight=float(floor))
    if surface == "weighted_factor_return":
        portfolio = B.factor_portfolio(weights, one)
    else:
        scored = B.stock_scores_from_signals(weights, signals, G.registry_frame(panel.sparkSession, G.COMPUTABLE))
        portfolio = B.qspread_portfolio(B.qspread_members(scored, panel))
    want = B.headline_summary(portfolio).first()
    got = study.where(
        (F.col("quantile") == "0.15") & (F.col("model") == model) & (F.col("min_weight") == floor)
        & (F.col("factor_universe") == universe) & (F.col("macro_feature_design") == design)
        & (F.col("portfolio_surface") == surface)
    ).collect()
    assert len(got) == 1 and got[0].periods == want.periods > 0
    for name in ("mean_monthly_return", "volatility_monthly", "cumulative_return", "max_drawdown"):
        assert got[0][name] == pytest.approx(want[name], abs=1e-12), name


def test_tables_of_the_lines_share_one_scan(spark):
    found = [make(spark, SF) for make in (T.security_month, T.estimate_month, T.target_month)]
    assert not [f for df in found for f in df.inputFiles() if "lineitem" in f]
    # sums and counts of all lines are in it
    assert T.supplier_month(spark, SF).agg(F.sum("n")).first()[0] == T.table(spark, SF, "lineitem").count()


def test_scores_are_computed_on_long_rows(spark):
    panel = spark.createDataFrame(synthetic(3, 12))
    plan = G.signal_scores(panel)._jdf.queryExecution().optimizedPlan().toString()
    assert "-5.0" in plan[:plan.index("Generate")] and "-5.0" not in plan[plan.index("Generate"):]
