"""Registered queries: each one applies an operator to whole tables of a scale directory.

Intermediate tables that many queries start from (feature panel, scores, factor returns,
forecasts, legs) are staged once per application and directory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fixed_growth, fixed_point, json_fields, json_payload
from ..operators import factors as G
from ..operators import features as X
from ..operators import folds as FD
from ..operators import hashtree as H
from ..operators import intervalbins as N
from ..operators import intervals as I
from ..operators import jobs as J
from ..operators import longseries as LS
from ..operators import metrics as M
from ..operators import models as L
from ..operators import panel as P
from ..operators import portfolio as B
from ..operators import reports as R
from ..operators import study as Y
from ..operators import textscan as Z
from ..plans.orderstats import ordinal_ranks
from ..plans.rangescan import cut_into_ranges, scan
from ..plans.staging import shared_stage, stage, stage_root
from ..sources import chunks as K
from ..sources import contracts as C
from ..sources import files as S
from ..sources import market_tables as T

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
# Queries beside them that no SQL can state: they fit models per variant.
STUDIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


def _fixed(df: DataFrame, keep: Sequence[str], rounded: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[fixed_point(c, digits).alias(c) for c in rounded])


# --- shared inputs ---------------------------------------------------------------------

def _monthly(spark, sf):
    return shared_stage(spark, "security_month", sf, lambda: T.security_month(spark, sf))


def _panel(spark, sf):
    return shared_stage(
        spark, "panel", sf, lambda: P.monthly_panel(_monthly(spark, sf), T.name_history(spark, sf), check_key=False)
    )


def _inputs(spark, sf):
    return {
        "comp_fundq": T.fundamentals_quarter(spark, sf), "ccm_link": T.company_link(spark, sf),
        "ibes_summary": T.estimate_month(spark, sf), "ibes_link": T.ticker_link(spark, sf),
        "ibes_target": T.target_month(spark, sf), "macro_features": T.macro_daily(spark, sf),
    }


def _feature_panel(spark, sf):
    return shared_stage(
        spark, "feature_panel", sf, lambda: X.build_features(_panel(spark, sf), _inputs(spark, sf)).frame
    )


def _signals(spark, sf):
    return shared_stage(
        spark, "signals", sf, lambda: G.signal_scores(_feature_panel(spark, sf), carry=["ret_1m_fwd"])
    )


def _all_returns(spark, sf):
    def build():
        legs = G.leg_returns(_signals(spark, sf), (0.10, 0.15, 0.20, 0.30), by="signal", return_column="ret_1m_fwd")
        return legs.join(G.registry_frame(spark, G.COMPUTABLE).select("signal", "factor_id"), "signal").drop("signal")

    return shared_stage(spark, "factor_returns", sf, build)


def _returns(spark, sf, quantile: float = 0.20):
    return _all_returns(spark, sf).where(F.col("quantile") == quantile)


def _macro(spark, sf):
    return shared_stage(spark, "macro_design", sf, lambda: G.macro_design(_feature_panel(spark, sf)))


def _baseline(spark, sf):
    return shared_stage(
        spark, "baseline", sf,
        lambda: L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="baseline_mean").predictions,
    )


def _allocations(spark, sf):
    return shared_stage(spark, "allocations", sf, lambda: B.factor_allocations(_baseline(spark, sf)))


def _stock_scores(spark, sf):
    registry = G.registry_frame(spark, G.COMPUTABLE)
    return B.stock_scores_from_signals(_allocations(spark, sf), _signals(spark, sf), registry)


def _members(spark, sf):
    return shared_stage(
        spark, "members", sf, lambda: B.qspread_members(_stock_scores(spark, sf), _panel(spark, sf))
    )


def _qspread(spark, sf):
    return shared_stage(spark, "qspread", sf, lambda: B.qspread_portfolio(_members(spark, sf)))


def _predictions(spark, sf):
    """Reversal forecasts of next month's return, with the split of their month."""
    def build():
        rows = T.predictions(_monthly(spark, sf))
        months = _monthly(spark, sf).where(F.col("ret").isNotNull()).select(F.col("date").alias("formation_date"))
        splits = L.chronological_split(months).withColumnRenamed("formation_date", "period")
        return rows.join(stage(splits, "splits"), "period")

    return shared_stage(spark, "predictions", sf, build)


def _model_predictions(spark, sf):
    """Three forecasters side by side: reversal, momentum and small size."""
    def build():
        sides = {
            "reversal": -F.col("ret_1m"), "momentum": F.col("crsp__mom_12_2"), "small_size": -F.col("crsp__log_size"),
        }
        forecasts = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("prediction")) for n, c in sides.items()])
        return _feature_panel(spark, sf).select(
            F.col("permno").alias("id"), F.col("formation_date").alias("period"),
            F.col("ret_1m_fwd").alias("actual"), F.inline(forecasts),
        )

    return shared_stage(spark, "model_predictions", sf, build)


def _run_metrics(spark, sf):
    def build():
        rows = _model_predictions(spark, sf)
        rows = rows.where(F.col("actual").isNotNull() & F.col("prediction").isNotNull())
        ic = M.period_ic(rows, ["model"]).groupBy("model").agg(
            F.avg("rank_ic").alias("rank_ic"), F.avg("pearson_ic").alias("pearson_ic")
        )
        return ic.join(M.pair_errors(rows, ["model"]), "model").withColumnRenamed("model", "run_id")

    return shared_stage(spark, "run_metrics", sf, build)


def _events(spark, sf):
    return T.job_events(spark, sf)


# --- contracts and prepared tables -----------------------------------------------------

@query
def table_summary(spark, sf):
    return C.table_summary(T.table(spark, sf, "orders"), "o_orderdate")


@query
def contract_dates(spark, sf):
    return C.date_profile(T.name_history(spark, sf), list(C.CONTRACTS["crsp_names"].dates))


@query
def contract_table_dates(spark, sf):
    """Date spans of all tables with a contract that the links need, one scan each."""
    names = ("ccm_link", "ibes_link")
    tables = {n: t for n, t in _inputs(spark, sf).items() if n in names}
    return C.table_date_spans(spark, {"crsp_monthly": _monthly(spark, sf), "crsp_names": T.name_history(spark, sf), **tables})


@query
def contract_duplicates(spark, sf):
    return C.duplicate_key_count(T.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def contract_report(spark, sf):
    tables = {
        "crsp_monthly": _monthly(spark, sf), "crsp_names": T.name_history(spark, sf), **_inputs(spark, sf),
    }
    report = C.contract_report(spark, tables)
    missing = F.when(F.col("missing_columns") == "", 0).otherwise(F.size(F.split("missing_columns", ",")))
    return report.select("table_name", "found", missing.alias("missing"), "parse_failures", "duplicate_count", "ok")


@query
def prepared_feature_merge(spark, sf):
    features = _feature_panel(spark, sf)
    price = X.crsp_features(_panel(spark, sf)).select(*X.PANEL_KEY, *X.CRSP_FEATURES)
    other = features.select(*X.PANEL_KEY, "crsp__mom_12_2", "compustat__pb", "ibes__surprise")
    merged = S.merge_prepared_features([price, other])
    return _fixed(merged, X.PANEL_KEY, ["crsp__mom_12_2", "crsp__reversal_1m", "compustat__pb", "ibes__surprise"])


# --- point-in-time joins ---------------------------------------------------------------

@query
def universe_point_in_interval(spark, sf):
    universe = P.monthly_universe(_monthly(spark, sf), T.name_history(spark, sf))
    return universe.select(
        "permno", "permco", "formation_date", *[fixed_point(c).alias(c) for c in ("price", "adjusted_price", "ret_1m")],
        fixed_point("market_cap", 1).alias("market_cap"), "shrout", "vol", "shrcd", "exchcd",
    )


@query
def link_overlap_intervals(spark, sf):
    links = I.company_links(T.company_link(spark, sf), T.name_history(spark, sf))
    return links.select("gvkey", "permno", "linkprim", "linktype", "linkdt", "linkenddt", "valid_start", "valid_end",
                        "shrcd", "exchcd", "namedt", "nameenddt")


@query
def estimate_link_intervals(spark, sf):
    links = I.estimate_links(T.ticker_link(spark, sf), T.name_history(spark, sf))
    return links.select("permno", "score", "sdate", "valid_start", "valid_end", "shrcd", "exchcd", "namedt", "nameenddt")


@query
def interval_overlap_count(spark, sf):
    company = I.overlap_count(T.company_link(spark, sf), ["gvkey"], "linkdt", "linkenddt")
    listing = I.overlap_count(T.name_history(spark, sf), ["exchcd"], "namedt", "nameenddt")
    return company.select(F.lit("company_link").alias("source"), "*").unionByName(
        listing.select(F.lit("listing").alias("source"), "*")
    )


@query
def link_diagnostics(spark, sf):
    links = T.company_link(spark, sf)
    resolved = I.company_links(links, T.name_history(spark, sf))
    row = I.link_diagnostics(links, resolved, source_id="lpermno", row_key=["gvkey", "linkdt"], keys=["gvkey"],
                             start="linkdt", end="linkenddt")
    return row.withColumn("unmatched_rate", fixed_point("unmatched_rate"))


@query
def estimate_link_diagnostics(spark, sf):
    row = I.estimate_link_diagnostics(T.ticker_link(spark, sf), T.name_history(spark, sf))
    return row.withColumn("unmatched_rate", fixed_point("unmatched_rate"))


@query
def unmatched_security_months(spark, sf):
    months = _monthly(spark, sf).select("permno", "date")
    return I.unmatched_rows(months, I.resolve_names(months, T.name_history(spark, sf)), ["permno", "date"])


@query
def resolve_permno(spark, sf):
    months = _monthly(spark, sf).select("permno", "date")
    return I.resolve_names(months, T.name_history(spark, sf)).drop("nameenddt")


@query
def resolve_gvkey(spark, sf):
    months = _monthly(spark, sf).select(F.lpad(F.col("permno").cast("string"), 6, "0").alias("gvkey"), "date")
    return I.resolve_company(months, T.company_link(spark, sf))


@query
def resolve_ticker(spark, sf):
    months = _monthly(spark, sf).select(F.concat(F.lit("T"), F.col("permno").cast("string")).alias("ticker"), "date")
    return I.resolve_ticker(months, T.ticker_link(spark, sf))


@query
def resolve_identifiers(spark, sf):
    number = F.col("permno").cast("string")
    asked = F.array(
        F.struct(F.lit("permno").alias("kind"), number.alias("identifier")),
        F.struct(F.lit("gvkey").alias("kind"), F.lpad(number, 6, "0").alias("identifier")),
        F.struct(F.lit("ibes_ticker").alias("kind"), F.concat(F.lit(" t"), number).alias("identifier")),
    )
    requests = _monthly(spark, sf).select("date", F.inline(asked))
    return I.resolve_identifiers(requests, T.name_history(spark, sf), T.company_link(spark, sf), T.ticker_link(spark, sf))


# --- panel -----------------------------------------------------------------------------

@query
def forward_returns(spark, sf):
    labels = P.forward_returns(_monthly(spark, sf))
    dates = ["forward_return_start", "forward_return_end", "forward_return_end_3m", "forward_return_end_6m"]
    return _fixed(labels, ["permno", "formation_date", *dates], ["ret_1m_fwd", "ret_3m_fwd", "ret_6m_fwd"])


@query
def monthly_panel(spark, sf):
    panel = P.monthly_panel(_monthly(spark, sf), T.name_history(spark, sf))
    keep = ["permno", "formation_date", "exchcd", "forward_return_start", "forward_return_end_6m", "universe_source",
            "label_source"]
    return _fixed(panel, keep, ["price", "ret_1m", "ret_1m_fwd", "ret_3m_fwd", "ret_6m_fwd"])


@query
def label_window_check(spark, sf):
    return P.label_window_check(_panel(spark, sf))


def _third(panel):
    return panel.count() // 3


@query
def cap_chronological(spark, sf):
    panel = _panel(spark, sf)
    return P.cap_rows(panel, _third(panel), "chronological").select("permno", "formation_date")


@query
def cap_date_balanced(spark, sf):
    panel = _panel(spark, sf)
    return P.cap_rows(panel, _third(panel), "date-balanced").select("permno", "formation_date")


@query
def cap_whole_periods(spark, sf):
    panel = _panel(spark, sf)
    return P.cap_whole_periods(panel, _third(panel)).select("permno", "formation_date")


# --- features --------------------------------------------------------------------------

@query
def momentum_reversal_size(spark, sf):
    return _fixed(X.crsp_features(_panel(spark, sf)), X.PANEL_KEY, list(X.CRSP_FEATURES))


@query
def fundamental_ratios(spark, sf):
    ratios = X.fundamental_ratios(T.fundamentals_quarter(spark, sf))
    return _fixed(ratios, ["gvkey", "datadate", "available_date"], list(X.COMPUSTAT_FEATURES))


@query
def fundamentals_asof(spark, sf):
    built = X.build_features(_panel(spark, sf), _inputs(spark, sf), ["compustat"])
    return _fixed(built.frame, X.PANEL_KEY, list(X.COMPUSTAT_FEATURES))


@query
def estimate_features_asof(spark, sf):
    built = X.build_features(_panel(spark, sf), _inputs(spark, sf), ["ibes"])
    large = "ibes__target_price_mean"
    return built.frame.select(
        *X.PANEL_KEY, *[fixed_point(c, 3 if c == large else 6).alias(c) for c in X.IBES_FEATURES]
    )


@query
def macro_month_end(spark, sf):
    snapshots = X.macro_month_end(T.macro_daily(spark, sf))
    return _fixed(snapshots, ["formation_date"], [f"macro__{c}" for c in T.PRIORITIES], 3)


def _wide_design(spark, sf, design):
    dates = _panel(spark, sf).select("permno", "formation_date")
    matrix = G.macro_design(X.add_macro(dates, T.macro_daily_wide(spark, sf)), design)
    return _fixed(matrix, ["formation_date"], [c for c in matrix.columns if c != "formation_date"], 3)


@query
def macro_design_25x3(spark, sf):
    """The design of levels and two changes, over the series that the tables give."""
    return _wide_design(spark, sf, "us_macro_25x3")


@query
def macro_design_expanded(spark, sf):
    return _wide_design(spark, sf, "us_macro_expanded")


@query
def macro_design_matrix(spark, sf):
    return _fixed(G.macro_design(_feature_panel(spark, sf)), ["formation_date"], [f"macro__{c}" for c in T.PRIORITIES], 3)


@query
def macro_on_trading_days(spark, sf):
    """Panel dates two days before the month end, which must not see the snapshot of the month end."""
    panel = _panel(spark, sf).select("permno", F.date_sub("formation_date", 2).alias("formation_date"))
    macro = T.macro_daily(spark, sf)
    names = [f"macro__{c}" for c in T.PRIORITIES]
    blank = X.add_macro(panel, macro).select("permno", "formation_date", *[F.col(n).alias(f"end_{n}") for n in names])
    known = X.add_macro(panel, macro, as_of="formation_date").select("permno", "formation_date", *names)
    both = known.join(blank, ["permno", "formation_date"])
    return _fixed(both, ["permno", "formation_date"], [*names, *[f"end_{n}" for n in names]], 3)


@query
def narrowed_inputs(spark, sf):
    narrowed = X.narrow_inputs(_inputs(spark, sf), _panel(spark, sf))
    counts = [
        narrowed[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
        for name in ("comp_fundq", "ccm_link", "ibes_link", "ibes_summary", "ibes_target")
    ]
    return reduce(DataFrame.unionByName, counts)


def _filled(spark, sf, columns):
    """Number of values that are not missing, by feature column of the panel."""
    built = _feature_panel(spark, sf)
    counts = built.agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "feature", "filled")


# --- factors ---------------------------------------------------------------------------

@query
def factor_registry(spark, sf):
    """Every registered factor with the number of panel rows that fill its source column."""
    registry = G.registry_frame(spark).select("factor_id", "factor_family", "scope", "source_column", "status")
    built = _feature_panel(spark, sf).columns
    sources = sorted({f.source_column for f in G.FACTORS if f.source_column in built})
    filled = _filled(spark, sf, sources).withColumnRenamed("feature", "source_column")
    return registry.join(filled, "source_column", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))


def _scores(spark, sf, scope):
    factors = [f for f in G.COMPUTABLE if f.scope == scope]
    scores = G.factor_scores(_feature_panel(spark, sf), factors)
    return scores.select(
        "formation_date", "permno", "factor_id", "factor_family", fixed_point("raw_value", 4).alias("raw_value"),
        fixed_point("factor_score").alias("factor_score"),
    )


@query
def factor_scores_global(spark, sf):
    return _scores(spark, sf, "global")


@query
def factor_scores_local(spark, sf):
    return _scores(spark, sf, "local")


@query
def factor_long_short_returns(spark, sf):
    returns = G.panel_factor_returns(_feature_panel(spark, sf), quantiles=(0.2,))
    return _fixed(returns, ["formation_date", "factor_id", "long_count", "short_count"],
                  ["long_return", "short_return", "factor_long_short_ret_1m"])


@query
def quantile_sweep(spark, sf):
    return _fixed(_all_returns(spark, sf), ["formation_date", "factor_id", "quantile", "long_count", "short_count"],
                  ["factor_long_short_ret_1m"])


@query
def alpha_global(spark, sf):
    return _fixed(G.global_alpha(_returns(spark, sf)), ["factor_id", "observations"],
                  ["mean_return", "volatility", "global_score"])


@query
def alpha_local(spark, sf):
    return _fixed(G.local_alpha(_returns(spark, sf), _macro(spark, sf)), ["factor_id"], ["local_score"])


@query
def factor_universe_topk(spark, sf):
    chosen = G.select_universe(_returns(spark, sf), _macro(spark, sf), universe="selected_13_global_local")
    return _fixed(chosen, ["factor_id", "selection_rank"], ["combined_score", "global_score", "local_score"])


@query
def score_row_estimate(spark, sf):
    panel = _feature_panel(spark, sf)
    return panel.agg(F.count(F.lit(1)).alias("panel_rows")).withColumn(
        "score_rows", F.col("panel_rows") * len(G.COMPUTABLE)
    )


@query
def parameter_grid_returns(spark, sf):
    axes = {"quantile": G.GRID_AXES["quantile"], "universe": G.GRID_AXES["factor_universe"]}
    grid = G.parameter_grid(spark, axes).withColumn("quantile", F.col("quantile").cast("double"))
    members = [
        G.select_universe(_returns(spark, sf), _macro(spark, sf), universe=u).select(
            F.lit(u).alias("universe"), "factor_id"
        )
        for u in G.GRID_AXES["factor_universe"]
    ]
    eligible = grid.join(stage(reduce(DataFrame.unionByName, members), "universes"), "universe")
    r = F.col("factor_long_short_ret_1m")
    joined = _all_returns(spark, sf).where(r.isNotNull()).join(eligible, ["quantile", "factor_id"])
    return joined.groupBy("quantile", "universe").agg(
        F.count(F.lit(1)).alias("factor_months"), fixed_point(F.avg(r)).alias("mean_return"),
        fixed_point(F.stddev_pop(r)).alias("volatility"),
    )


def parameter_grid_study(spark, sf):
    """The whole grid: all six axes, each runnable combination with the summary of its portfolio."""
    return Y.grid_study(_feature_panel(spark, sf), _all_returns(spark, sf), _signals(spark, sf))


STUDIES["parameter_grid_study"] = parameter_grid_study


# --- models ----------------------------------------------------------------------------

@query
def split_chronological(spark, sf):
    months = _monthly(spark, sf).where(F.col("ret").isNotNull())
    return L.chronological_split(months.select(F.col("date").alias("formation_date")))


@query
def label_stage_chunks(spark, sf):
    """The label stage as one job into a chunked table; one row for each finished chunk."""
    location = f"{stage_root(spark)}/label-stage-{uuid.uuid4().hex}"
    K.label_stage(_monthly(spark, sf), T.name_history(spark, sf), location)
    return K.entered_chunks(spark, location).select("chunk", "first_date", "last_date", "dates", F.col("rows").alias("n_rows"))


def forest_factor_forecast(spark, sf):
    """A forest of 100 trees for every factor and fold, grown together."""
    return L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="random_forest").predictions


def leafwise_factor_forecast(spark, sf):
    """Leaf-wise boosting for every factor and fold."""
    return L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="lightgbm").predictions


STUDIES |= {"forest_factor_forecast": forest_factor_forecast, "leafwise_factor_forecast": leafwise_factor_forecast}


def _model_frame(spark, sf):
    return _returns(spark, sf).join(_macro(spark, sf), "formation_date")


@query
def walk_forward_folds(spark, sf):
    return L.walk_forward_folds(_model_frame(spark, sf)).select("factor_id", "formation_date", "fold", "role")


@query
def holdout_split(spark, sf):
    return L.holdout_split(_model_frame(spark, sf)).select("factor_id", "formation_date", "role")


@query
def baseline_mean_forecast(spark, sf):
    forecast = L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="baseline_mean").predictions
    first = F.dense_rank().over(L.Window.partitionBy("factor_id").orderBy("fold_start")) - 1
    return _fixed(forecast.withColumn("fold", first), ["factor_id", "formation_date", "fold"],
                  ["prediction", "factor_long_short_ret_1m"])


@query
def factor_model_metrics(spark, sf):
    metrics = L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="baseline_mean").metrics
    return _fixed(metrics, ["factor_id", "fold_count", "train_rows", "validation_rows", "holdout_rows"],
                  ["validation_mae", "holdout_mae", "validation_correlation", "holdout_correlation"])


def _model_metrics(spark, sf):
    return shared_stage(
        spark, "model_metrics", sf,
        lambda: L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="baseline_mean").metrics,
    )


@query
def top_factor_models(spark, sf):
    return _fixed(R.top_factor_models(_model_metrics(spark, sf)), ["factor_id"], ["holdout_correlation"])


@query
def baseline_median_forecast(spark, sf):
    forecast = L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="baseline_median").predictions
    return _fixed(forecast, ["factor_id", "formation_date", "fold_start"], ["prediction", "factor_long_short_ret_1m"])


@query
def ridge_factor_forecast(spark, sf):
    return L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="ridge").predictions


@query
def ridge_normal_equations(spark, sf):
    """Gram matrix and target products of every factor and fold, from running sums."""
    held = FD.fold_rows(stage(_model_frame(spark, sf), "model_frame"), [c for c in _macro(spark, sf).columns if c != "formation_date"], L.TARGET)
    return _fixed(FD.normal_equations(held, alpha=1.0), ["factor_id", "fold", "feature_a", "feature_b"], ["gram", "target_product"])


@query
def elastic_net_factor_forecast(spark, sf):
    return L.train_factor_models(_returns(spark, sf), _macro(spark, sf), model="elasticnet").predictions


def _panel_metrics(spark, sf, model, **params):
    panel = _feature_panel(spark, sf)
    return L.evaluate_panel_model(panel, model=model, params=params).metrics


@query
def panel_ridge_eval(spark, sf):
    return _panel_metrics(spark, sf, "ridge")


@query
def panel_elastic_net_eval(spark, sf):
    return _panel_metrics(spark, sf, "elasticnet")


@query
def panel_forest_eval(spark, sf):
    return _panel_metrics(spark, sf, "random_forest")


@query
def panel_boosting_eval(spark, sf):
    return _panel_metrics(spark, sf, "boosting")


@query
def feature_importance(spark, sf):
    return L.evaluate_panel_model(_feature_panel(spark, sf), model="random_forest").importance


@query
def period_runs(spark, sf):
    panel = _panel(spark, sf)
    place = F.unix_date("formation_date").cast("long") * 10_000_000 + F.col("permno")
    return L.period_runs(panel.withColumn("place", place), order="place", period="formation_date")


@query
def ordinal_target_ranks(spark, sf):
    ranked = ordinal_ranks(_panel(spark, sf), ["formation_date"], "vol", "permno", "target_rank")
    return ranked.select("permno", "formation_date", "target_rank")


# --- portfolios ------------------------------------------------------------------------

@query
def factor_allocations(spark, sf):
    return _fixed(B.factor_allocations(_baseline(spark, sf)), ["formation_date", "factor_id", "split"],
                  ["prediction", "weight"])


def _portfolio(spark, sf):
    return B.factor_portfolio(_allocations(spark, sf), _returns(spark, sf))


@query
def factor_portfolio(spark, sf):
    return _portfolio(spark, sf).select(
        "formation_date", "split", fixed_point("portfolio_return").alias("portfolio_return"),
        fixed_growth("cumulative_return").alias("cumulative_return"),
    )


@query
def portfolio_summary(spark, sf):
    summary = B.portfolio_summary(_portfolio(spark, sf))
    return summary.select(
        "split", "periods", *[fixed_point(c).alias(c) for c in ("mean_monthly_return", "volatility_monthly")],
        fixed_growth("cumulative_return").alias("cumulative_return"), fixed_point("max_drawdown").alias("max_drawdown"),
    )


@query
def headline_summary(spark, sf):
    summary = B.headline_summary(_portfolio(spark, sf))
    return _fixed(summary, ["surface", "periods"], ["mean_monthly_return", "volatility_monthly", "max_drawdown"])


@query
def stock_score(spark, sf):
    return _fixed(_stock_scores(spark, sf), ["formation_date", "permno", "split", "factors_used"],
                  ["stock_score", "max_factor_weight", "herfindahl_weight"])


@query
def qspread_portfolio(spark, sf):
    portfolio = B.qspread_portfolio(_members(spark, sf))
    rounded = ["portfolio_return", "long_turnover", "short_turnover", "turnover", "max_factor_weight",
               "mean_herfindahl_weight"]
    return portfolio.select(
        "formation_date", "split", "long_count", "short_count",
        fixed_growth("cumulative_return").alias("cumulative_return"), *[fixed_point(c).alias(c) for c in rounded],
    )


@query
def qspread_legs(spark, sf):
    return _fixed(B.qspread_legs(_members(spark, sf)), ["formation_date", "split", "leg", "permno"],
                  ["stock_score", "forward_return"])


@query
def leg_turnover(spark, sf):
    turnover = B.leg_turnover(B.qspread_legs(_members(spark, sf)))
    return _fixed(turnover, ["formation_date", "split"], ["long_turnover", "short_turnover"])


# --- prediction metrics ----------------------------------------------------------------

@query
def ic_by_period(spark, sf):
    return _fixed(M.period_ic(_predictions(spark, sf)), ["split", "period", "rows"], ["rank_ic", "pearson_ic"])


@query
def decile_long_short(spark, sf):
    return _fixed(M.period_long_short(_predictions(spark, sf)), ["split", "period"], ["long_short_return"])


@query
def top_turnover(spark, sf):
    return _fixed(M.top_turnover_by_period(_predictions(spark, sf)), ["split", "period"], ["turnover"])


@query
def drawdown(spark, sf):
    spread = M.period_long_short(_predictions(spark, sf))
    return _fixed(M.max_drawdown(spread, ["split"], value="long_short_return", order="period"), ["split"],
                  ["max_drawdown"])


@query
def ic_stability(spark, sf):
    stability = M.ic_stability(stage(M.period_ic(_predictions(spark, sf)), "ic"))
    return _fixed(stability, ["split"], ["ic_std", "positive_ic_share", "yearly_ic_std"])


@query
def prediction_metrics(spark, sf):
    bundle = M.evaluate_predictions(_predictions(spark, sf))
    return _fixed(bundle, ["split", "row_count", "period_count"], [
        "rank_ic", "pearson_ic", "decile_long_short_return", "hit_rate", "mse", "mae", "turnover_proxy", "max_drawdown",
        "ic_std", "positive_ic_share", "yearly_ic_std",
    ])


@query
def feature_coverage(spark, sf):
    columns = [*X.COMPUSTAT_FEATURES, *X.IBES_FEATURES]
    return _fixed(M.feature_coverage(_feature_panel(spark, sf), columns, ["exchcd"]), ["exchcd"], ["feature_coverage"])


# --- reports ---------------------------------------------------------------------------

@query
def select_by_validation(spark, sf):
    metrics = _run_metrics(spark, sf).withColumnRenamed("run_id", "model").withColumn("split", F.lit("validation"))
    return _fixed(M.select_by_validation(metrics), ["model", "selection_metric"], ["validation_value"])


@query
def leaderboard(spark, sf):
    return _fixed(R.leaderboard(_run_metrics(spark, sf)), ["run_id", "position"], ["rank_ic", "mae"])


@query
def promotion_gate(spark, sf):
    gated = R.promotion_by_threshold(_run_metrics(spark, sf), {"rank_ic": 0.0, "hit_rate": 0.5})
    return _fixed(gated, ["run_id", "promotion_status"], ["rank_ic"])


@query
def metric_trend(spark, sf):
    runs = _run_metrics(spark, sf).withColumn("started_at", F.lit(None).cast("timestamp"))
    return _fixed(R.metric_trend(runs), ["run_id", "metric"], ["value"])


# The stored metric that each kind of event stands for.
RUN_METRICS = {"view": "rank_ic", "click": "hit_rate", "purchase": "mse", "signup": "mae", "error": "max_drawdown"}


@query
def run_metric_pivot(spark, sf):
    name = F.create_map(*[F.lit(x) for p in RUN_METRICS.items() for x in p])
    stored = T.table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("run_id"), F.try_element_at(name, F.col("event_type")).alias("name"), "value",
        F.col("event_id").alias("metric_id"),
    )
    return R.metric_pivot(stored, tuple(RUN_METRICS.values()))


@query
def merged_runs(spark, sf):
    ledger = T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job_id"),
        fixed_point("o_totalprice", 2).alias("total"),
    )
    artifacts = T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.max("l_suppkey").alias("job_id"), fixed_point(F.sum("l_extendedprice"), 2).alias("total")
    )
    merged = R.merge_runs(ledger, artifacts, J.current_state(_events(spark, sf)))
    return merged.withColumn("status", F.nullif(F.col("status"), F.lit("UNKNOWN")))


def _published(spark, sf):
    return _model_predictions(spark, sf).select(
        F.col("model").alias("run_id"), F.col("period").alias("date"), F.col("id").alias("asset_id"),
        "prediction", F.col("actual").alias("target_return"),
    )


@query
def prediction_summary(spark, sf):
    return _fixed(R.prediction_summary(_published(spark, sf)),
                  ["run_id", "rows", "periods", "first_period", "last_period"], ["target_mean", "prediction_mean"])


@query
def prediction_series(spark, sf):
    return _fixed(R.prediction_series(_published(spark, sf)), ["run_id", "date"], ["prediction"])


@query
def coverage_by_month(spark, sf):
    return R.coverage_by_month(_published(spark, sf))


@query
def feature_family_uses(spark, sf):
    built = X.build_features(_panel(spark, sf), _inputs(spark, sf))
    described = X.feature_metadata(spark, built)
    names = sorted(built.metadata)
    filled = described.join(_filled(spark, sf, names), "feature")
    values = filled.groupBy(F.substring_index("feature", "_", 1).alias("family")).agg(F.sum("filled").alias("filled_values"))
    return R.feature_family_uses(described).join(values, "family")


@query
def run_set_fingerprint(spark, sf):
    figure = F.floor(F.col("rank_ic") * 1e6 + 0.5001).cast("bigint").cast("string")
    text = F.concat(F.col("run_id"), F.lit(":"), figure)
    return R.run_set_fingerprint(
        _run_metrics(spark, sf).select(F.substring(F.sha2(text, 256), 1, 16).alias("repro_hash"))
    )


def _order_hashes(spark, sf, status):
    text = F.concat_ws(":", F.col("o_orderkey").cast("string"), status)
    return T.table(spark, sf, "orders").select(F.substring(F.sha2(text, 256), 1, 16).alias("repro_hash"))


@query
def run_set_hash_tree(spark, sf):
    """Every order as a run; its state is what is hashed."""
    return H.hash_tree(_order_hashes(spark, sf, F.col("o_orderstatus")), depth=2)


@query
def run_set_differences(spark, sf):
    """The same orders with one priority's state changed: the values that only one set holds."""
    changed = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("P")).otherwise(F.col("o_orderstatus"))
    return H.differing_values(
        _order_hashes(spark, sf, F.col("o_orderstatus")), _order_hashes(spark, sf, changed), depth=2
    )


# --- series of any length --------------------------------------------------------------

@query
def running_order_value(spark, sf):
    """Running total, largest order and latest urgent order of each state, in order of time."""
    cents = fixed_point("o_totalprice", 2) * 100
    orders = T.table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderdate", "o_orderkey", F.rint(cents).cast("long").alias("cents"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("urgent"),
    )
    by, order = ["o_orderstatus"], ["o_orderdate", "o_orderkey"]
    running = {"total_cents": ("sum", "cents"), "most_cents": ("max", "cents"), "latest_urgent": ("last", "urgent")}
    return scan(cut_into_ranges(orders, by, order), by, order, running).select("o_orderkey", *running)


@query
def order_value_drawdown(spark, sf):
    """Drawdown of a return series with one row an order, few keys."""
    step = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 2001
    orders = T.table(spark, sf, "orders").withColumn("change", (step - 1000).cast("double") / 100000.0)
    deepest = LS.max_drawdown_ranged(orders, ["o_orderstatus"], value="change", order=["o_orderdate", "o_orderkey"])
    return _fixed(deepest, ["o_orderstatus"], ["max_drawdown"])


@query
def shipment_asof_order_day(spark, sf):
    """Each line with the latest earlier order day of its state: two keys hold all lines."""
    days = T.table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("state"), F.to_date("o_orderdate").alias("available_date")
    ).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last_orderkey"))
    days = days.withColumn("order_day", F.col("available_date"))
    lines = T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("state"), F.to_date("l_shipdate").alias("day")
    )
    return LS.asof_backward_ranged(lines, [(days, ["order_day", "orders", "last_orderkey"])], key="state", left_date="day")


def _order_months(spark, sf):
    day = F.to_date("o_orderdate")
    return T.table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("state"), F.date_format(day, "yyyy-MM").alias("month")
    ).agg(F.min(day).alias("opened"), F.date_add(F.max(day), 45).alias("closed"))


@query
def shipments_in_order_months(spark, sf):
    """Lines per span of their state that holds the ship day; two identifiers hold all lines."""
    lines = T.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("state"), F.to_date("l_shipdate").alias("day"), "l_quantity"
    )
    active = N.join_active_binned(lines, _order_months(spark, sf), "state", "day", "opened", "closed", bin_days=31)
    return active.groupBy("state", "month").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("long").alias("quantity")
    )


@query
def shipment_spans_over_order_months(spark, sf):
    """Lines in transit (from ship day, a day a unit) per span of their state that they overlap."""
    lines = T.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("line_state"), F.to_date("l_shipdate").alias("left_on"), "l_quantity",
        F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")).alias("there_on"),
    )
    pairs = N.overlap_join_binned(
        lines, _order_months(spark, sf), on="line_state", right_on="state", left_span=("left_on", "there_on"),
        right_span=("opened", "closed"), bin_days=31,
    )
    return pairs.groupBy("state", "month").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("long").alias("quantity")
    )


@query
def yearly_returns(spark, sf):
    return R.yearly_returns(_qspread(spark, sf)).select(
        "split", "year", fixed_growth("year_return").alias("year_return"), "months"
    )


@query
def worst_months(spark, sf):
    return _fixed(R.worst_months(_qspread(spark, sf)), ["split", "formation_date", "position"], ["portfolio_return"])


@query
def cost_break_even(spark, sf):
    return _fixed(R.cost_break_even(_qspread(spark, sf)), ["split"], ["mean_return", "mean_turnover", "break_even_cost"])


@query
def leg_contribution(spark, sf):
    legs = B.qspread_legs(_members(spark, sf))
    return _fixed(R.leg_contribution(legs), ["split", "leg", "members"], ["mean_forward_return", "mean_score"])


@query
def score_gap(spark, sf):
    gap = R.score_gap(B.qspread_legs(_members(spark, sf)), _qspread(spark, sf))
    return _fixed(gap, ["split"], ["mean_score_gap", "gap_return_correlation"])


@query
def concentration_effect(spark, sf):
    return _fixed(R.concentration_effect(_qspread(spark, sf)), ["split", "concentration", "months"], ["mean_return"])


@query
def factor_weight_means(spark, sf):
    return _fixed(R.factor_weight_means(_allocations(spark, sf)), ["split", "factor_id"], ["mean_weight", "max_weight"])


@query
def weight_skill_correlation(spark, sf):
    skill = R.weight_skill_correlation(_allocations(spark, sf), _model_metrics(spark, sf))
    return _fixed(skill, ["split"], ["weight_skill_correlation"])


@query
def promotion_by_state(spark, sf):
    runs = merged_runs(spark, sf).withColumn("rank_ic", F.when(F.col("total") > 100000, F.col("total")))
    return R.promotion_by_state(runs).groupBy("status", "promotion_status").agg(F.count(F.lit(1)).alias("runs"))


# --- job history -----------------------------------------------------------------------

@query
def job_current_state(spark, sf):
    return J.current_state(_events(spark, sf))


@query
def job_transition_audit(spark, sf):
    # events state where they come from; every 50th one names another state
    stepped = J.with_previous_state(_events(spark, sf))
    stated = F.when(F.col("event_id") % 50 == 0, "PROPOSED").otherwise(F.col("previous_state"))
    return J.audit_summary(J.transition_audit(stepped.withColumn("from_state", stated).drop("previous_state")))


@query
def job_payloads(spark, sf):
    """Payload of each event as JSON text, and one of its fields read back."""
    events = _events(spark, sf).withColumn("payload", json_payload(("to_state", "event_type", "job_id")))
    return events.select("event_id", "payload", F.try_element_at(json_fields("payload"), F.lit("job_id")).alias("job_field"))


@query
def features_on_panel_dates(spark, sf):
    """Features of all dates, kept for the dates of a panel of every second month."""
    built = _feature_panel(spark, sf).select("permno", "formation_date", "crsp__reversal_1m")
    kept = X.on_panel_dates(built, _panel(spark, sf).where(F.month("formation_date") % 2 == 0))
    return _fixed(kept, ["permno", "formation_date"], ["crsp__reversal_1m"])


@query
def job_failure_rate(spark, sf):
    budget = J.trial_budget(J.current_state(_events(spark, sf)), hard_cap=20)
    return _fixed(budget, ["jobs", "trial_count"], ["queue_factor", "failure_rate", "adjustment"])


@query
def expired_leases(spark, sf):
    events = _events(spark, sf)
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return J.expired_leases(J.leases_from_events(events), J.current_state(events), now).select(
        "job_id", "state", "expires_at"
    )


@query
def dead_letter_listing(spark, sf):
    events = _events(spark, sf)
    return J.dead_letters(events, J.current_state(events))


# --- texts -----------------------------------------------------------------------------

@query
def text_pattern_findings(spark, sf):
    return Z.pattern_findings(T.table(spark, sf, "documents"))


@query
def network_pattern_findings(spark, sf):
    return Z.pattern_findings(T.table(spark, sf, "documents"), Z.NETWORK_PATTERNS, skip_comments=True)


@query
def address_findings(spark, sf):
    """A caller's own pattern: lines with an IPv4 address, comments passed over."""
    return Z.pattern_findings(
        T.table(spark, sf, "documents"), [("ipv4_address", r"\b\d{1,3}(?:\.\d{1,3}){3}\b")], skip_comments=True
    )


@query
def page_structure(spark, sf):
    return Z.page_structure(T.table(spark, sf, "pages")).drop("url", "html")


@query
def broken_links(spark, sf):
    problems = Z.link_errors(T.table(spark, sf, "pages"))
    return problems.groupBy("page_id", "href", "problem").agg(F.count(F.lit(1)).alias("links"))
