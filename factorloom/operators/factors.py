"""Factor registry, cross-sectional scores, long-short returns and universe selection.

Many factors read the same column in the same scope and direction.  The work is done once
per such signal, 23 instead of 54, and the results are copied to the factors at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clipped, fixed_point
from ..plans.orderstats import grouped_quantiles
from ..plans.staging import fixed_table, stage
from ..sources.contracts import require_columns


@dataclass(frozen=True)
class Factor:
    factor_id: str
    name_ko: str
    source_column: str | None
    direction: float
    status: str
    family: str
    scope: str

    @property
    def signal(self) -> str:
        return f"{self.source_column}|{self.scope}|{'+' if self.direction > 0 else '-'}"

    @property
    def computable(self) -> bool:
        return self.source_column is not None and self.status in ("implemented", "proxy")


# Id prefix -> family name.
_FAMILY = {
    "val": "valuation", "earn": "earnings", "quality": "quality_growth", "price": "price_momentum",
    "reversal": "reversal", "size": "size_flow", "flow": "size_flow",
}

# Id | Korean name | source column | direction | status.
_REGISTRY = """
val_global_relative_pe_industry_fwd | 상대P/E (업종 대비, forward) | compustat__pe_proxy | - | proxy
val_global_relative_pb_industry_fwd | 상대P/B (업종 대비, forward) | compustat__pb | - | proxy
val_global_pc_ttm | P/C (직전4분기, 개별) | compustat__debt_to_assets | - | proxy
val_global_pb_fwd | P/B (forward) | compustat__pb | - | proxy
val_global_pe_fwd | P/E (forward) | compustat__pe_proxy | - | proxy
val_local_relative_pe_industry_fwd | 상대P/E (업종 대비, forward) | compustat__pe_proxy | - | proxy
val_local_pb_fwd | P/B (forward) | compustat__pb | - | proxy
val_local_pb_lastq | P/B (직전분기) | compustat__pb | - | implemented
val_local_pe_fwd | P/E (forward) | compustat__pe_proxy | - | proxy
val_local_relative_pb_industry_fwd | 상대P/B (업종 대비, forward) | compustat__pb | - | proxy
earn_global_op_income_change_fy2_1m_voladj | 변동성조정 영업이익 변화율 (FY2, 1m) | ibes__revision_1m | + | proxy
earn_global_op_income_change_fq1_1m | 영업이익 변화율 (FQ1, 1m) | ibes__revision_1m | + | proxy
earn_global_eps_fast_fy1_1m_voladj | 변동성조정 EPS 변화율 (빠른 FY1, 1m) | ibes__revision_1m | + | implemented
earn_global_eps_fast_fy1_1m | EPS 변화율 (빠른 FY1, 1m) | ibes__revision_1m | + | implemented
earn_global_eps_fq1_1m | EPS 변화율 (FQ1, 1m) | ibes__revision_1m | + | proxy
earn_global_eps_fy2_1m_voladj | 변동성조정 EPS 변화율 (FY2, 1m) | ibes__revision_1m | + | proxy
earn_global_err_fast_eps1_1m | 이익조정비율 (빠른 EPS1, 1m) | ibes__revision_1m | + | implemented
earn_global_op_income_change_fy1_1m | 영업이익 변화율 (FY1, 1m) | ibes__revision_1m | + | proxy
earn_global_time_adjusted_ni_surprise_fqo | 시간조정 순이익 서프라이즈 (FQO) | ibes__surprise | + | implemented
earn_global_op_income_change_fy1_1m_voladj | 변동성조정 영업이익 변화율 (FY1, 1m) | ibes__estimate_dispersion | - | proxy
earn_global_op_income_change_fy2_1m | 영업이익 변화율 (FY2, 1m) | ibes__revision_1m | + | proxy
earn_global_ni_surprise_fqo | 순이익 서프라이즈 (FQO) | ibes__surprise | + | implemented
earn_global_eps_fy2_1m | EPS 변화율 (FY2, 1m) | ibes__revision_1m | + | proxy
earn_global_eps_fq2_1m | EPS 변화율 (FQ2, 1m) | ibes__revision_1m | + | proxy
earn_global_target_price_gap_1m | 목표가 괴리율 (1개월컨센) | ibes__target_price_mean | + | implemented
earn_global_op_income_change_fq2_1m | 영업이익 변화율 (FQ2, 1m) | ibes__revision_1m | + | proxy
earn_local_eps_fq1_1m | EPS 변화율 (FQ1, 1m) | ibes__revision_1m | + | proxy
earn_local_ni_surprise_fqo | 순이익 서프라이즈 (FQO) | ibes__surprise | + | implemented
earn_local_target_price_gap_1m | 목표가 괴리율 (1개월컨센) | ibes__target_price_mean | + | implemented
earn_local_target_price_gap_3m | 목표가 괴리율 (3개월컨센) | ibes__target_revision_balance_1m | + | proxy
earn_local_op_income_change_fy2_1m_voladj | 변동성조정 영업이익 변화율 (FY2, 1m) | ibes__estimate_dispersion | - | proxy
earn_local_time_adjusted_ni_surprise_fqo | 시간조정 순이익 서프라이즈 (FQO) | ibes__surprise | + | implemented
earn_local_eps_fast_fy1_1m_voladj | 변동성조정 EPS 변화율 (빠른 FY1, 1m) | ibes__revision_1m | + | proxy
earn_local_op_income_change_fq1_1m | 영업이익 변화율 (FQ1, 1m) | ibes__revision_1m | + | proxy
earn_local_eps_fast_fy1_1m | EPS 변화율 (빠른 FY1, 1m) | ibes__revision_1m | + | implemented
earn_local_eps_fy2_1m_voladj | 변동성조정 EPS 변화율 (FY2, 1m) | ibes__revision_1m | + | proxy
earn_local_op_income_change_fy1_1m | 영업이익 변화율 (FY1, 1m) | ibes__revision_1m | + | proxy
earn_local_op_income_surprise_fqo | 영업이익 서프라이즈 (FQO) | ibes__surprise | + | proxy
earn_local_op_income_change_fy2_1m | 영업이익 변화율 (FY2, 1m) | ibes__revision_1m | + | proxy
earn_local_err_fast_eps1_1m | 이익조정비율 (빠른 EPS1, 1m) | ibes__revision_1m | + | implemented
earn_local_eps_fy2_1m | EPS 변화율 (FY2, 1m) | ibes__revision_1m | + | proxy
earn_local_op_income_change_fq2_1m | 영업이익 변화율 (FQ2, 1m) | ibes__revision_1m | + | proxy
earn_local_op_income_change_fy1_1m_voladj | 변동성조정 영업이익 변화율 (FY1, 1m) | ibes__estimate_dispersion | - | proxy
quality_global_operating_income_yoy | 영업이익 증가율 (FQO, yoy) | compustat__revenue_yoy | + | proxy
quality_global_net_income_yoy | 순이익 증가율 (FQO, yoy) | compustat__net_income_yoy | + | implemented
quality_local_operating_income_yoy | 영업이익 증가율 (FQO, yoy) | compustat__revenue_yoy | + | proxy
quality_local_net_income_yoy | 순이익 증가율 (FQO, yoy) | compustat__net_income_yoy | + | implemented
price_local_momentum_12m_1m | 주가 모멘텀 (12m - 1m) | crsp__mom_12_2 | + | implemented
price_local_momentum_3m | 주가 모멘텀 (3m) | crsp__mom_6_2 | + | proxy
reversal_local_price_reversal_3m | 주가 리버전 (3m) | crsp__mom_6_2 | - | proxy
reversal_local_ma_gap_3m | 이격도 리버전 (3m) | crsp__mom_6_2 | - | proxy
reversal_local_ma_gap_1m | 이격도 리버전 (1m) | crsp__reversal_1m | - | proxy
reversal_local_price_reversal_1m | 주가 리버전 (1m) | crsp__reversal_1m | - | implemented
size_local_small_size | 소형주 | crsp__log_size | - | implemented
flow_local_retail_net_buy_1m | 개인 순매수 (1m) | None | + | unavailable
"""


def _parse(line: str) -> Factor:
    factor_id, name, source, sign, status = (part.strip() for part in line.split("|"))
    prefix, scope = factor_id.split("_")[:2]
    return Factor(factor_id, name, None if source == "None" else source, 1.0 if sign == "+" else -1.0, status,
                  _FAMILY[prefix], scope)


FACTORS: tuple[Factor, ...] = tuple(_parse(line) for line in _REGISTRY.strip().splitlines())
COMPUTABLE: tuple[Factor, ...] = tuple(f for f in FACTORS if f.computable)

_REGISTRY_SCHEMA = (
    "factor_id string, factor_name_ko string, factor_family string, scope string, source_column string, "
    "direction double, status string, signal string, position int"
)


def registry_frame(spark: SparkSession, factors: Sequence[Factor] = FACTORS) -> DataFrame:
    """The factors as a table; its size is that of the given list, not of the data."""
    rows = [
        (f.factor_id, f.name_ko, f.family, f.scope, f.source_column, f.direction, f.status,
         f.signal if f.source_column else None, n)
        for n, f in enumerate(factors, start=1)
    ]
    return fixed_table(spark, rows, _REGISTRY_SCHEMA)


# --- scores ----------------------------------------------------------------------------

def _moments(panel: DataFrame, keys: list[str], columns: Sequence[str], tag: str) -> DataFrame:
    sums = []
    for c in columns:
        sums += [F.avg(c).alias(f"{c}|{tag}|mean"), F.stddev_samp(c).alias(f"{c}|{tag}|std")]
    return stage(panel.groupBy(*keys).agg(*sums), f"moments_{tag}")


def _zscore(value: str, mean: str, std: str) -> Column:
    spread = F.col(std)
    return F.when(spread > 1e-12, clipped((F.col(value) - F.col(mean)) / F.nullif(spread, F.lit(0.0)), -5.0, 5.0))


def signal_scores(
    panel: DataFrame, factors: Sequence[Factor] = COMPUTABLE, *, carry: Sequence[str] = (),
    float32_scores: bool = True,
) -> DataFrame:
    """Long scores per distinct signal: formation_date, permno, carried columns, signal, raw, score.

    Scores have single precision unless switched off.  That makes values equal that differ
    only by how their date's mean was added up, so ties at a cut do not depend on the order
    of the rows.

    Mean and deviation per date (and exchange) are aggregated with map-side combining and
    joined back, one row per date: the cross section itself is never sorted or shuffled.
    """
    require_columns(panel, ["formation_date", "permno"], "feature panel")
    local = "exchcd" in panel.columns
    usable = [f for f in factors if f.computable and f.source_column in panel.columns]
    signals = {f.signal: f for f in usable}
    rows = panel.where(F.col("formation_date").isNotNull() & F.col("permno").isNotNull())

    def tag(f: Factor) -> str:
        return "local" if f.scope == "local" and local else "global"

    for scope, keys in (("global", ["formation_date"]), ("local", ["formation_date", "exchcd"])):
        columns = sorted({f.source_column for f in usable if tag(f) == scope})
        if columns:
            source = rows if scope == "global" else rows.where(F.col("exchcd").isNotNull())
            rows = rows.join(_moments(source, keys, columns, scope), keys, "left")
    kind = "float" if float32_scores else "double"
    # scores are computed on the long rows: with 23 of them in one row the generated method is too long to be compiled
    packed = [
        F.struct(
            F.lit(name).alias("signal"), F.col(f.source_column).cast("double").alias("_raw"),
            F.col(f"`{f.source_column}|{tag(f)}|mean`").alias("_mean"),
            F.col(f"`{f.source_column}|{tag(f)}|std`").alias("_std"), F.lit(float(f.direction)).alias("_direction"),
        )
        for name, f in signals.items()
    ]
    long = rows.select("formation_date", "permno", *carry, F.inline(F.array(*packed)))
    score = (_zscore("_raw", "_mean", "_std") * F.col("_direction")).cast(kind)
    return long.select(
        "formation_date", "permno", *carry, "signal", F.col("_raw").cast(kind).alias("raw_value"), score.alias("factor_score")
    ).where(F.col("factor_score").isNotNull())


def factor_scores(panel: DataFrame, factors: Sequence[Factor] = COMPUTABLE, **options) -> DataFrame:
    """Long scores per factor, with the factor's attributes."""
    registry = registry_frame(panel.sparkSession, factors)
    carry = list(options.get("carry", ()))
    return signal_scores(panel, factors, **options).join(registry, "signal").select(
        "formation_date", "permno", *carry, "factor_id", "factor_name_ko", "factor_family", "scope",
        "source_column", "status", "raw_value", "factor_score",
    )


def score_row_estimate(panel: DataFrame, factors: Sequence[Factor] = COMPUTABLE, *, limit: int | None = None) -> int:
    """Panel rows times factors; with a limit, an early error before any score is computed."""
    rows = panel.count() * len(factors)
    if limit is not None and rows > limit:
        raise ValueError(f"about {rows} score rows exceed the limit of {limit}")
    return rows


# --- long-short returns ----------------------------------------------------------------

def _check_quantile(quantile: float) -> None:
    if not 0.0 < quantile < 0.5:
        raise ValueError("quantile must lie between 0 and 0.5")


def leg_returns(
    scored: DataFrame, quantiles: Sequence[float], *, by: str, return_column: str, min_rows: int = 10
) -> DataFrame:
    """Mean return of the top and the bottom share of each date and ``by`` group.

    ``scored`` holds scores with their return.  All quantiles are cut from one selection and
    measured in one aggregation.  Ties at a cut belong to the leg.  Groups with fewer than
    ``min_rows`` complete rows get missing returns and zero counts.
    """
    keys = ["formation_date", by]
    score, forward = F.col("factor_score"), F.col(return_column)
    complete = scored.where(forward.isNotNull() & score.isNotNull())
    named: dict[str, float] = {}
    for i, q in enumerate(quantiles):
        _check_quantile(q)
        named |= {f"long_cut_{i}": 1.0 - q, f"short_cut_{i}": float(q)}
    cuts = stage(grouped_quantiles(complete, keys, "factor_score", named), "cuts")
    joined = scored.join(cuts, keys, "left")
    sums: list[Column] = [F.max("group_rows").alias("group_rows")]
    for i in range(len(quantiles)):
        in_long = forward.isNotNull() & (score >= F.col(f"long_cut_{i}"))
        in_short = forward.isNotNull() & (score <= F.col(f"short_cut_{i}"))
        sums += [
            F.avg(F.when(in_long, forward)).alias(f"long_return_{i}"), F.count_if(in_long).alias(f"long_count_{i}"),
            F.avg(F.when(in_short, forward)).alias(f"short_return_{i}"), F.count_if(in_short).alias(f"short_count_{i}"),
        ]
    wide = joined.groupBy(*keys).agg(*sums)
    enough = F.coalesce(F.col("group_rows"), F.lit(0)) >= min_rows
    legs = [
        F.struct(
            F.lit(float(q)).alias("quantile"),
            F.when(enough, F.col(f"long_return_{i}")).alias("long_return"),
            F.when(enough, F.col(f"short_return_{i}")).alias("short_return"),
            F.when(enough, F.col(f"long_return_{i}") - F.col(f"short_return_{i}")).alias("factor_long_short_ret_1m"),
            F.when(enough, F.col(f"long_count_{i}")).otherwise(0).alias("long_count"),
            F.when(enough, F.col(f"short_count_{i}")).otherwise(0).alias("short_count"),
        )
        for i, q in enumerate(quantiles)
    ]
    out = wide.select(*keys, F.inline(F.array(*legs)))
    return out.withColumn("label_horizon", F.lit(return_column))


def long_short_returns(
    scores: DataFrame, panel: DataFrame, *, return_column: str = "ret_1m_fwd", quantile: float = 0.2
) -> DataFrame:
    """One forward long-short return per factor and date, from stored scores."""
    _check_quantile(quantile)
    require_columns(scores, ["formation_date", "permno", "factor_id", "factor_score"], "factor scores")
    require_columns(panel, ["formation_date", "permno", return_column], "panel")
    scored = scores.join(panel.select("formation_date", "permno", return_column), ["formation_date", "permno"])
    return leg_returns(scored, [quantile], by="factor_id", return_column=return_column)


def panel_factor_returns(
    panel: DataFrame, factors: Sequence[Factor] = COMPUTABLE, *, return_column: str = "ret_1m_fwd",
    quantiles: Sequence[float] = (0.2,),
) -> DataFrame:
    """Long-short returns of all factors straight from a feature panel with labels.

    The scores are staged once per signal with their return, so no join by security is
    needed; the per-signal results are copied to the factors at the end.
    """
    scored = stage(signal_scores(panel, factors, carry=[return_column]), "scored")
    legs = leg_returns(scored, quantiles, by="signal", return_column=return_column)
    registry = registry_frame(panel.sparkSession, factors).select("signal", "factor_id")
    return legs.join(registry, "signal").drop("signal")


# --- alpha screens and selection -------------------------------------------------------
# From here on a table has at most one row per factor and date.

def global_alpha(returns: DataFrame) -> DataFrame:
    """Mean over deviation of each factor's returns, not below zero."""
    r = F.col("factor_long_short_ret_1m")
    stats = returns.where(r.isNotNull()).groupBy("factor_id").agg(
        F.avg(r).alias("mean_return"), F.stddev_pop(r).alias("volatility"), F.count(r).alias("observations")
    )
    typical = F.median(F.abs("mean_return")).over(Window.partitionBy()) + 1e-9
    risk = F.coalesce(F.nullif(F.col("volatility"), F.lit(0.0)), typical)
    return stats.withColumn("global_score", F.greatest(F.lit(0.0), F.col("mean_return") / risk))


def macro_columns(names: Sequence[str], design: str = "current_macro_family") -> tuple[list[str], list[str]]:
    """Macro columns of a design that are present, and those that are missing."""
    available = {n for n in names if n.startswith("macro__")}
    if design == "current_macro_family":
        return sorted(available), []
    if design not in MACRO_DESIGNS:
        raise ValueError(f"unknown macro design: {design}")
    bases, suffixes = MACRO_DESIGNS[design]
    wanted = [f"macro__{b}{s}" for b in bases for s in suffixes]
    return [c for c in wanted if c in available], [c for c in wanted if c not in available]


# Base series and suffixes of the macro designs.
US_MACRO_BASES = (
    "sp500", "nasdaq", "treasury_2y", "treasury_10y", "treasury_10_3_diff", "treasury_10_2_diff", "fed_funds",
    "tips_10y", "breakeven_10y", "cpi", "core_cpi", "pce", "payrolls", "unemployment", "housing_starts",
    "retail_sales", "industrial_prod", "vix", "hy_spread", "baa_10y_spread", "nfci", "fed_total_assets",
    "dxy_proxy", "usd_jpy", "wti",
)
MACRO_DESIGNS = {
    "us_macro_25x3": (US_MACRO_BASES, ("", "_c20", "_c60")),
    "us_macro_expanded": (
        (*US_MACRO_BASES, "consumer_sentiment"), ("", "_c20", "_c60", "_m1", "_m3", "_yoy"),
    ),
}


def macro_design(panel: DataFrame, design: str = "current_macro_family") -> DataFrame:
    """One row per date with the design's macro columns.

    Macro values are the same for all securities of a date; among differing values the one
    of the highest security number counts.
    """
    columns, _ = macro_columns(panel.columns, design)
    if not columns:
        raise ValueError(f"no macro columns for the design {design}")
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("permno"))).alias(c) for c in columns]
    return panel.where(F.col("formation_date").isNotNull()).groupBy("formation_date").agg(*values)


def macro_states(macro: DataFrame, *, limit: int = 8) -> DataFrame:
    """Long table (formation_date, state_column, state): each varying series, high or low.

    High means at or above the median over dates; a missing value counts as low.
    """
    columns = [c for c in macro.columns if c != "formation_date"]
    distinct = macro.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    varying = [c for c in columns if distinct[c] > 1][:limit]
    if not varying:
        return macro.select("formation_date", F.lit("").alias("state_column"), F.lit("").alias("state")).limit(0)
    medians = {f"{c}|median": F.median(c).over(Window.partitionBy()) for c in varying}
    state = [
        F.struct(
            F.lit(c).alias("state_column"),
            F.when(F.col(c) >= F.col(f"`{c}|median`"), "high").otherwise("low").alias("state"),
        )
        for c in varying
    ]
    return macro.withColumns(medians).select("formation_date", F.inline(F.array(*state)))


def local_alpha(returns: DataFrame, macro: DataFrame) -> DataFrame:
    """Best mean return of each factor over the macro states, not below zero."""
    r = F.col("factor_long_short_ret_1m")
    usable = returns.where(r.isNotNull())
    by_state = usable.join(macro_states(macro), "formation_date").groupBy("factor_id", "state_column", "state").agg(
        F.avg(r).alias("state_mean")
    )
    best = by_state.groupBy("factor_id").agg(F.greatest(F.lit(0.0), F.max("state_mean")).alias("local_score"))
    return usable.select("factor_id").distinct().join(best, "factor_id", "left").select(
        "factor_id", F.coalesce("local_score", F.lit(0.0)).alias("local_score")
    )


def percentile_rank(*values: str) -> Column:
    """Average rank divided by the number of rows, over a table of factors; summed over the values.

    Ranks are whole or half numbers and add up exactly, so equal sums tie; only the total is divided."""
    total = F.lit(0.0)
    for value in values:
        ties = F.count(F.lit(1)).over(Window.partitionBy(value))
        total = total + F.rank().over(Window.orderBy(value)) + (ties - 1) / 2
    return total / F.count(values[0]).over(Window.partitionBy())


def alpha_table(returns: DataFrame, macro: DataFrame) -> DataFrame:
    """Both alpha scores and the sum of their percentile ranks.

    Twelve decimals count: factors with the same signal have the same score and must tie,
    whatever the order in which their returns were added up."""
    both = global_alpha(returns).join(local_alpha(returns, macro), "factor_id", "full").na.fill(0.0)
    both = both.withColumns({c: fixed_point(c, 12) for c in ("global_score", "local_score")})
    return both.withColumn("combined_score", percentile_rank("global_score", "local_score"))


UNIVERSES = ("all_implemented_current", "selected_13_global_local", "selected_13_plus_us_overrides")


def select_universe(
    returns: DataFrame, macro: DataFrame, factors: Sequence[Factor] = COMPUTABLE, *,
    universe: str = "all_implemented_current", target_count: int = 13, overrides: Sequence[str] = (),
) -> DataFrame:
    """Eligible factors with their rank and the reason for it."""
    registry = registry_frame(returns.sparkSession, factors)
    if universe not in UNIVERSES:
        raise ValueError(f"unknown factor universe: {universe}")
    if universe == "all_implemented_current":
        return registry.withColumnsRenamed({"position": "selection_rank"}).withColumn(
            "selection_reason", F.lit(universe)
        )
    known = {f.factor_id for f in factors}
    seeds = list(dict.fromkeys(o for o in overrides if o in known)) if universe.endswith("overrides") else []
    alpha = alpha_table(returns, macro)
    seeded = F.lit(None).cast("int")
    if seeds:
        order = F.create_map(*[F.lit(x) for n, s in enumerate(seeds) for x in (s, n)])
        seeded = F.try_element_at(order, F.col("factor_id"))
    # a seed belongs to the set even if it has no returns
    ranked = registry.join(alpha, "factor_id", "left").withColumn("_seed", seeded)
    ranked = ranked.where(F.col("combined_score").isNotNull() | F.col("_seed").isNotNull())
    first = Window.orderBy(
        F.asc_nulls_last("_seed"), F.desc("combined_score"), F.desc("global_score"), F.desc("local_score"), "factor_id"
    )
    reason = F.when(F.col("_seed").isNotNull(), "us_override_seed").otherwise("global_local_alpha")
    return (
        ranked.withColumns({"selection_rank": F.row_number().over(first), "selection_reason": reason})
        .where(F.col("selection_rank") <= target_count).drop("_seed", "position")
    )


# --- parameter grid --------------------------------------------------------------------

# The axes of the parameter study and their choices, in order; which of them can
# run on a panel, `study.runnable_axes` tells (a macro design needs one of its columns).
GRID_AXES: dict[str, tuple[str, ...]] = {
    "quantile": ("0.10", "0.15", "0.20", "0.30"),
    "model": ("lightgbm", "baseline_mean", "ridge", "elasticnet"),
    "min_weight": ("0.0", "0.01", "0.03"),
    "factor_universe": ("all_implemented_current", "selected_13_global_local"),
    "macro_feature_design": ("current_macro_family", "us_macro_25x3", "us_macro_expanded"),
    "portfolio_surface": ("weighted_factor_return", "stock_score_qspread"),
}


def parameter_grid(spark: SparkSession, axes: dict[str, Sequence[str]] | None = None, *, limit: int | None = None) -> DataFrame:
    """All combinations of the axis choices, last axis fastest, numbered from 1.

    The number of combinations is the product of the axis lengths.  A combination is decoded
    from its number, so no product of tables is formed.
    """
    axes = dict(axes or GRID_AXES)
    total = 1
    for choices in axes.values():
        total *= len(choices)
    grid = spark.range(total if limit is None else min(limit, total))
    columns, block = [], total
    for name, choices in axes.items():
        block //= len(choices)
        place = (F.floor(F.col("id") / block) % len(choices)).cast("int")
        columns.append(F.element_at(F.array(*[F.lit(c) for c in choices]), place + 1).alias(name))
    return grid.select((F.col("id") + 1).alias("variant"), *columns)
