"""Metrics of cross-sectional predictions.

Input rows have actual, prediction, period and, for set comparisons, id.  Every metric is
computed per ``by`` group, for instance per split or model.  A period may hold any number of
securities: ranks and cuts come from counts per value, not from a sort of the period.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import guarded_correlation
from ..plans.orderstats import distinct_value_ranks, pick_ranked
from ..plans.staging import stage
from .portfolio import compounded


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["actual", "prediction", "period"])


def period_ic(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rank and linear correlation of forecast and outcome per period.

    Periods with fewer than two rows or a constant side have no correlation."""
    keys = [*by, "period"]
    rows = complete_rows(df).select(*keys, F.col("actual").cast("double"), F.col("prediction").cast("double"))
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col("actual").alias("v")),
        F.struct(F.lit("p").alias("side"), F.col("prediction").alias("v")),
    )
    ranks = distinct_value_ranks(rows.select(*keys, F.inline(sides)), [*keys, "side"], "v")
    ranks = stage(ranks.select(*keys, "side", "v", "average_rank"), "ranks")

    def side(name: str, column: str, out: str) -> DataFrame:
        return ranks.where(F.col("side") == name).select(
            *keys, F.col("v").alias(column), F.col("average_rank").alias(out)
        )

    ranked = rows.join(side("a", "actual", "rank_a"), [*keys, "actual"]).join(
        side("p", "prediction", "rank_p"), [*keys, "prediction"]
    )
    varied = (F.min("actual") < F.max("actual")) & (F.min("prediction") < F.max("prediction"))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.when(varied, guarded_correlation(F.col("rank_p"), F.col("rank_a"))).alias("rank_ic"),
        F.when(varied, guarded_correlation(F.col("prediction"), F.col("actual"))).alias("pearson_ic"),
    )


def _end_size(rows, fraction: float):
    return F.greatest(F.lit(1), F.ceil(rows * F.lit(float(fraction))))


def end_members(df: DataFrame, by: Sequence[str], fraction: float = 0.1) -> DataFrame:
    """Rows in the top or bottom share of their period by (prediction, id), with both flags.

    The share is rounded up.  Equal predictions are told apart by id."""
    keys = [*by, "period"]
    rows = df.dropna(subset=["prediction", "period", "id"])
    picks = pick_ranked(
        rows, keys, "prediction",
        {"bottom": lambda n: _end_size(n, fraction) - 1, "top": lambda n: n - _end_size(n, fraction)}, tie="id",
    )

    def value(name: str, column: str):
        return F.max(F.when(F.col("pick") == name, F.col(column))).alias(f"{name}_{column}")

    cuts = picks.groupBy(*keys).agg(
        F.max("group_rows").alias("group_rows"), *[value(n, c) for n in ("bottom", "top") for c in ("value", "tie")]
    )
    p, i = F.col("prediction"), F.col("id")
    below = (p < F.col("bottom_value")) | ((p == F.col("bottom_value")) & (i <= F.col("bottom_tie")))
    above = (p > F.col("top_value")) | ((p == F.col("top_value")) & (i >= F.col("top_tie")))
    return rows.join(stage(cuts, "end_cuts"), keys).withColumns({"in_bottom": below, "in_top": above}).drop(
        "bottom_value", "bottom_tie", "top_value", "top_tie"
    )


def period_long_short(df: DataFrame, by: Sequence[str] = ("split",), fraction: float = 0.1) -> DataFrame:
    """Mean outcome of the top share minus the bottom share; periods of one row are left out."""
    members = end_members(complete_rows(df), by, fraction).where(F.col("group_rows") >= 2)
    top, bottom = (F.avg(F.when(F.col(flag), F.col("actual"))) for flag in ("in_top", "in_bottom"))
    return members.groupBy(*by, "period").agg((top - bottom).alias("long_short_return"))


def max_drawdown(returns: DataFrame, by: Sequence[str], *, value: str, order: str) -> DataFrame:
    """Deepest fall of the compounded returns below their running peak; one row per period in."""
    in_order = Window.partitionBy(*by).orderBy(order)
    rows = returns.where(F.col(value).isNotNull()).withColumn("_equity", compounded(F.col(value), in_order) + 1)
    peak = F.max("_equity").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawdown = F.col("_equity") / F.nullif(peak, F.lit(0.0)) - 1
    return rows.withColumn("_d", drawdown).groupBy(*by).agg(F.min("_d").alias("max_drawdown"))


def top_turnover_by_period(df: DataFrame, by: Sequence[str] = ("split",), fraction: float = 0.1) -> DataFrame:
    """Symmetric difference over union of the top sets of following periods."""
    keys = list(by)
    top = end_members(df, by, fraction).where(F.col("in_top")).select(*keys, "period", "id").distinct()
    top = stage(top, "top_members")
    sizes = top.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy(*keys).orderBy("period")
    sizes = sizes.withColumns({"number": F.row_number().over(order), "size_before": F.lag("size").over(order)})
    sizes = stage(sizes, "top_sizes")
    numbered = top.join(sizes.select(*keys, "period", "number"), [*keys, "period"])
    following = numbered.select(*keys, "id", (F.col("number") + 1).alias("number"))
    kept = numbered.join(following, [*keys, "id", "number"], "left_semi").groupBy(*keys, "number").agg(
        F.count(F.lit(1)).alias("kept")
    )
    both = F.col("size") + F.col("size_before")
    shared = F.coalesce("kept", F.lit(0))
    return sizes.where(F.col("size_before").isNotNull()).join(kept, [*keys, "number"], "left").select(
        *keys, "period", ((both - 2 * shared) / F.greatest(F.lit(1), both - shared)).alias("turnover")
    )


def ic_stability(ic: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Deviation of the rank correlations, their positive share, deviation of yearly means."""
    keys = list(by)
    known = ic.where(F.col("rank_ic").isNotNull())
    overall = known.groupBy(*keys).agg(
        F.stddev_pop("rank_ic").alias("ic_std"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_ic_share"),
    )
    yearly = known.groupBy(*keys, F.year("period").alias("y")).agg(F.avg("rank_ic").alias("mean_ic")).groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 2, F.stddev_pop("mean_ic")).alias("yearly_ic_std")
    )
    return overall.join(yearly, keys)


def pair_errors(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Hit rate, squared and absolute error, complete rows and periods, in one aggregation."""
    a, p = F.col("actual"), F.col("prediction")
    both = a.isNotNull() & p.isNotNull()
    signed = both & (a != 0) & (p != 0)
    return df.groupBy(*by).agg(
        F.avg(F.when(signed, (F.signum(a) == F.signum(p)).cast("double"))).alias("hit_rate"),
        F.avg(F.when(both, F.pow(a - p, 2))).alias("mse"),
        F.avg(F.when(both, F.abs(a - p))).alias("mae"),
        F.count_if(both & F.col("period").isNotNull()).alias("row_count"),
        F.count_distinct("period").alias("period_count"),
    )


def feature_coverage(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("split",)) -> DataFrame:
    """Mean over the features of their filled share."""
    shares = [F.avg(F.col(f).isNotNull().cast("double")) for f in features]
    mean = reduce(lambda a, b: a + b, shares) / len(shares)
    return df.groupBy(*by).agg(mean.alias("feature_coverage"))


def evaluate_predictions(
    df: DataFrame, by: Sequence[str] = ("split",), *, features: Sequence[str] = (), coverage: DataFrame | None = None
) -> DataFrame:
    """All metrics, one row per group.

    The rows are read several times; pass a staged table if they are costly to compute.
    ``coverage`` (groups, feature_coverage) stands in for ``features`` that are not among the rows."""
    keys = list(by)
    ic = stage(period_ic(df, by), "ic")
    spread = stage(period_long_short(df, by), "spread")
    parts = [
        pair_errors(df, by),
        ic.groupBy(*keys).agg(F.avg("rank_ic").alias("rank_ic"), F.avg("pearson_ic").alias("pearson_ic")),
        spread.groupBy(*keys).agg(F.avg("long_short_return").alias("decile_long_short_return")),
        max_drawdown(spread, by, value="long_short_return", order="period"),
        top_turnover_by_period(df, by).groupBy(*keys).agg(F.avg("turnover").alias("turnover_proxy")),
        ic_stability(ic, by),
    ]
    if coverage is None and features:
        coverage = feature_coverage(df, features, by)
    if coverage is not None:
        parts.append(coverage)
    joined = reduce(lambda a, b: a.join(b, keys, "left"), parts)
    return joined if coverage is not None else joined.withColumn("feature_coverage", F.lit(None).cast("double"))


def select_by_validation(
    metrics: DataFrame, *, metric: str = "rank_ic", higher_is_better: bool = True, name: str = "model"
) -> DataFrame:
    """The candidate with the best finite validation metric; the holdout plays no part."""
    value = F.col(metric)
    finite = metrics.where((F.col("split") == "validation") & value.isNotNull() & ~F.isnan(value)
                           & (F.abs(value) != float("inf")))
    best = finite.orderBy(value.desc() if higher_is_better else value.asc(), name).limit(1)
    return best.select(
        name, F.lit(metric).alias("selection_metric"), value.alias("validation_value")
    )
