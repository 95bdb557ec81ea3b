"""Factor weights, the two portfolio surfaces, their legs, turnover and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_number
from ..plans.orderstats import grouped_quantiles
from ..plans.staging import stage
from ..sources.contracts import require_columns

SLICE = ["formation_date", "split"]


def factor_allocations(predictions: DataFrame, *, min_weight: float = 0.0) -> DataFrame:
    """Non-negative factor weights per date and split.

    Positive forecasts are scaled to one; without any, all factors get the same weight.  A
    floor lifts the scaled weights, which are then scaled again; equal weights have no floor.
    A date and split hold at most one row per factor.
    """
    group = Window.partitionBy(*SLICE)
    positive = F.greatest(F.lit(0.0), as_number("prediction"))
    rows = predictions.withColumn("_p", F.when(as_number("prediction").isNotNull(), positive))
    total = F.coalesce(F.sum("_p").over(group), F.lit(0.0))
    rows = rows.withColumns({"_total": total, "_n": F.count(F.lit(1)).over(group)})
    scaled = F.col("_p") / F.nullif(F.col("_total"), F.lit(0.0))
    if min_weight > 0:
        rows = rows.withColumn("_w", F.when(scaled.isNotNull(), F.greatest(F.lit(min_weight), scaled)))
        scaled = F.col("_w") / F.nullif(F.sum("_w").over(group), F.lit(0.0))
    weight = F.when(F.col("_total") > 0, scaled).otherwise(1.0 / F.col("_n"))
    return rows.withColumn("weight", weight).select("formation_date", "factor_id", "prediction", "split", "weight")


def compounded(returns: Column, window) -> Column:
    """Running compounded return; a missing return counts as zero."""
    return F.product(F.coalesce(returns, F.lit(0.0)) + 1).over(
        window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - 1


def with_cumulative(portfolio: DataFrame) -> DataFrame:
    """The cumulative return restarts in each split; one row per date and split."""
    by_split = Window.partitionBy("split").orderBy("formation_date")
    return portfolio.withColumn("cumulative_return", compounded(F.col("portfolio_return"), by_split))


def factor_portfolio(allocations: DataFrame, returns: DataFrame) -> DataFrame:
    """Weighted realised factor returns per date and split."""
    realised = returns.select("formation_date", "factor_id", "factor_long_short_ret_1m")
    weighted = allocations.join(realised, ["formation_date", "factor_id"], "left")
    summed = weighted.groupBy(*SLICE).agg(
        F.coalesce(F.sum(F.col("weight") * F.col("factor_long_short_ret_1m")), F.lit(0.0)).alias("portfolio_return")
    )
    return with_cumulative(summed)


def stock_scores(allocations: DataFrame, scores: DataFrame) -> DataFrame:
    """Weighted factor score per security, date and split.

    The weights are staged, so that their known size lets them be broadcast.  The scores of
    one security and date lie together, so the sums combine before the shuffle and only one
    row per security, date and split moves.
    """
    weights = stage(allocations.select("formation_date", "factor_id", "weight", "split"), "weights")
    joined = scores.select("formation_date", "permno", "factor_id", "factor_score").join(
        weights, ["formation_date", "factor_id"]
    )
    w = F.coalesce("weight", F.lit(0.0))
    return joined.groupBy("formation_date", "permno", "split").agg(
        F.coalesce(F.sum(F.col("factor_score") * F.col("weight")), F.lit(0.0)).alias("stock_score"),
        F.count_distinct("factor_id").alias("factors_used"),
        F.max("weight").alias("max_factor_weight"),
        F.sum(w * w).alias("herfindahl_weight"),
    )


def signal_weights(allocations: DataFrame, registry: DataFrame) -> DataFrame:
    """Sum, count, maximum and squares of the weights of the factors that share a signal, per date and split."""
    return allocations.join(registry.select("factor_id", "signal"), "factor_id").groupBy(*SLICE, "signal").agg(
        F.sum("weight").alias("w_sum"), F.count_distinct("factor_id").alias("w_count"),
        F.max("weight").alias("w_max"), F.sum(F.col("weight") * F.col("weight")).alias("w_squares"),
    )


def stock_scores_from_signals(allocations: DataFrame, signals: DataFrame, registry: DataFrame) -> DataFrame:
    """The same sums from one score per signal; ``registry`` maps factor_id to signal.

    Factors that share a signal share its score, so their weights are added up first and the
    scores need no copy per factor.
    """
    joined = signals.select("formation_date", "permno", "signal", "factor_score").join(
        stage(signal_weights(allocations, registry), "signal_weights"), ["formation_date", "signal"]
    )
    return joined.groupBy("formation_date", "permno", "split").agg(
        F.coalesce(F.sum(F.col("factor_score") * F.col("w_sum")), F.lit(0.0)).alias("stock_score"),
        F.sum("w_count").alias("factors_used"), F.max("w_max").alias("max_factor_weight"),
        F.coalesce(F.sum("w_squares"), F.lit(0.0)).alias("herfindahl_weight"),
    )


def qspread_members(
    scored: DataFrame, panel: DataFrame, *, return_column: str = "ret_1m_fwd", leg_quantile: float = 0.10
) -> DataFrame:
    """Complete rows of each date and split with flags for the two legs.

    The cuts come from counts per value cell, one small row per date and split, and are
    joined back; ties at a cut belong to the leg.
    """
    require_columns(panel, ["formation_date", "permno", return_column], "panel")
    realised = panel.select("formation_date", "permno", F.col(return_column).alias("forward_return"))
    rows = scored.join(realised, ["formation_date", "permno"]).where(
        F.col("stock_score").isNotNull() & F.col("forward_return").isNotNull()
    )
    rows = stage(rows, "qspread_rows")
    cuts = stage(
        grouped_quantiles(rows, SLICE, "stock_score", {"long_cut": 1.0 - leg_quantile, "short_cut": leg_quantile}),
        "qspread_cuts",
    )
    return rows.join(cuts, SLICE).withColumns(
        {"in_long": F.col("stock_score") >= F.col("long_cut"), "in_short": F.col("stock_score") <= F.col("short_cut")}
    ).drop("long_cut", "short_cut", "group_rows")


def qspread_legs(members: DataFrame) -> DataFrame:
    """One row per member and leg; a security may stand in both."""
    legs = F.array_compact(F.array(F.when(F.col("in_long"), "long"), F.when(F.col("in_short"), "short")))
    return members.select(*SLICE, F.explode(legs).alias("leg"), "permno", "stock_score", "forward_return")


def leg_turnover(legs: DataFrame, *, by_split: bool = False) -> DataFrame:
    """Share of each leg that was not in it in the previous group.

    Groups follow each other by date and split, across splits unless ``by_split`` is set.
    Membership is compared by a join on (group number, leg, security), which spreads over
    all securities; no list of members is built.
    """
    groups = legs.select(*SLICE).distinct()
    order = Window.partitionBy("split").orderBy("formation_date") if by_split else Window.orderBy(*SLICE)
    numbered = stage(groups.withColumn("number", F.row_number().over(order)), "groups")
    key = ["split"] if by_split else []
    members = legs.select(*SLICE, "leg", "permno").distinct().join(numbered, SLICE)
    before = members.select(*key, "leg", "permno", (F.col("number") + 1).alias("number"), F.lit(1).alias("kept"))
    compared = members.join(before, [*key, "leg", "permno", "number"], "left")
    sizes = compared.groupBy(*SLICE, "number", "leg").agg(F.count(F.lit(1)).alias("size"), F.sum("kept").alias("kept"))
    share = F.when(F.col("number") == 1, 1.0).otherwise(1.0 - F.coalesce(F.col("kept"), F.lit(0)) / F.col("size"))
    wide = sizes.withColumn("share", share).groupBy(*SLICE).agg(
        F.coalesce(F.max(F.when(F.col("leg") == "long", F.col("share"))), F.lit(0.0)).alias("long_turnover"),
        F.coalesce(F.max(F.when(F.col("leg") == "short", F.col("share"))), F.lit(0.0)).alias("short_turnover"),
    )
    return wide.withColumn("turnover", (F.col("long_turnover") + F.col("short_turnover")) / 2)


def qspread_portfolio(members: DataFrame, *, by_split: bool = False) -> DataFrame:
    """Mean return of the long leg minus the short leg, with counts, turnover and concentration."""
    r = F.col("forward_return")
    sums = members.groupBy(*SLICE).agg(
        (F.avg(F.when(F.col("in_long"), r)) - F.avg(F.when(F.col("in_short"), r))).alias("portfolio_return"),
        F.count_if("in_long").alias("long_count"), F.count_if("in_short").alias("short_count"),
        F.max("max_factor_weight").alias("max_factor_weight"),
        F.avg("herfindahl_weight").alias("mean_herfindahl_weight"),
    )
    return with_cumulative(sums.join(leg_turnover(qspread_legs(members), by_split=by_split), SLICE))


_DIAGNOSTICS = (
    "long_count", "short_count", "turnover", "long_turnover", "short_turnover", "max_factor_weight",
    "mean_herfindahl_weight",
)


def portfolio_summary(portfolio: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Periods, mean, deviation, cumulative return, drawdown and mean diagnostics per group.

    One row per date comes in.  The drawdown is measured from the first equity value."""
    keys = list(by)
    order = Window.partitionBy(*keys).orderBy("formation_date")
    r = F.coalesce(as_number("portfolio_return"), F.lit(0.0))
    rows = portfolio.withColumn("_r", r).withColumn("_equity", compounded(F.col("_r"), order) + 1)
    peak = F.max("_equity").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_drawdown", F.col("_equity") / F.nullif(peak, F.lit(0.0)) - 1)
    diagnostics = [F.avg(c).alias(c) for c in _DIAGNOSTICS if c in portfolio.columns]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"), F.avg("_r").alias("mean_monthly_return"),
        F.stddev_pop("_r").alias("volatility_monthly"),
        (F.max_by("_equity", "formation_date") - 1).alias("cumulative_return"),
        F.min("_drawdown").alias("max_drawdown"), *diagnostics,
    )


def headline_summary(portfolio: DataFrame) -> DataFrame:
    """Summary of the holdout if there is one, of everything otherwise."""
    held = portfolio.withColumn("_holdout", F.col("split") == "holdout")
    any_holdout = F.max("_holdout").over(Window.partitionBy())
    chosen = held.withColumn("_any", any_holdout).where(F.col("_holdout") | ~F.col("_any"))
    return portfolio_summary(chosen.withColumn("surface", F.when(F.col("_any"), "holdout").otherwise("all")),
                             ["surface"])
