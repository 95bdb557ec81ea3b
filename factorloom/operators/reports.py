"""Report tables over runs, metrics, predictions and portfolios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed_point, guarded_correlation
from ..plans.orderstats import distinct_value_ranks
from ..plans.staging import stage

# Metrics shown as trends, metrics where less is better, states and the metric
# that a promotion looks at.
TREND_METRICS = ("rank_ic", "pearson_ic", "hit_rate", "mse", "mae")
LOWER_IS_BETTER = ("mse", "mae", "max_drawdown", "runtime", "turnover_proxy")
PROMOTED_STATES = ("SUCCEEDED",)
DEAD_STATES = ("FAILED", "DEAD_LETTER", "REJECTED")
VALIDATION_METRIC = "rank_ic"


def merge_runs(ledger: DataFrame, artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs of both sources by run_id; ledger values win, the job's state is the status."""
    both = ledger.alias("l").join(artifacts.alias("a"), "run_id", "full")
    columns: list[Column | str] = ["run_id"]
    for name in dict.fromkeys([*ledger.columns, *artifacts.columns]):
        if name == "run_id":
            continue
        sides = [F.col(f"{s}.{name}") for s, df in (("l", ledger), ("a", artifacts)) if name in df.columns]
        columns.append(F.coalesce(*sides).alias(name))
    merged = both.select(*columns).join(jobs.select("job_id", F.col("state").alias("job_state")), "job_id", "left")
    known = [F.col("job_state")] + ([F.col("status")] if "status" in merged.columns else [])
    return merged.withColumn("status", F.coalesce(*known, F.lit("UNKNOWN"))).drop("job_state")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Latest value per run and metric name; metric_id gives the order."""
    return metrics.where(F.col("run_id").isNotNull()).groupBy("run_id", "name").agg(
        F.max_by("value", "metric_id").alias("value")
    )


def metric_pivot(metrics: DataFrame, names: Sequence[str] = TREND_METRICS) -> DataFrame:
    """One row per run with the latest value of each named metric."""
    return latest_metrics(metrics).groupBy("run_id").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    )


def metric_trend(runs: DataFrame, names: Sequence[str] = TREND_METRICS, *, started: str = "started_at") -> DataFrame:
    """Long table of the trend metrics of each run; order it by start and run."""
    present = [n for n in names if n in runs.columns]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in present])
    return runs.select("run_id", started, F.inline(pairs)).where(F.col("value").isNotNull())


def prediction_summary(predictions: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows, periods and means of the stored predictions, per group."""
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("periods"),
        F.min("date").alias("first_period"), F.max("date").alias("last_period"),
        F.avg("target_return").alias("target_mean"), F.avg("prediction").alias("prediction_mean"),
    )


def prediction_series(predictions: DataFrame, by: Sequence[str] = ("run_id",), points: int = 24) -> DataFrame:
    """Mean prediction per date for the last dates of each group."""
    daily = predictions.where(F.col("date").isNotNull()).groupBy(*by, "date").agg(
        F.avg("prediction").alias("prediction")
    )
    newest = Window.partitionBy(*by).orderBy(F.desc("date"))
    return daily.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= points).drop("_n")


def leaderboard(runs: DataFrame, metric: str = VALIDATION_METRIC) -> DataFrame:
    """Runs ranked by a metric in its own direction; missing values last, ties by run_id.

    Positions come from the counts of the distinct values, so the runs are never ordered in
    one task; only runs of equal value, or without one, are ordered among themselves.
    """
    rows = runs.withColumns({"_all": F.lit(1), "_v": F.col(metric).cast("double")})
    rows = rows.withColumn("_v", F.when(~F.isnan("_v") & (F.abs("_v") != float("inf")), F.col("_v") + 0.0))
    values = stage(distinct_value_ranks(rows, ["_all"], "_v"), "metric_values")
    total = values.groupBy("_all").agg(F.sum("rows_equal").alias("_valued"))
    placed = rows.join(values.select("_all", F.col("v").alias("_v"), "rows_below", "rows_equal"), ["_all", "_v"], "left")
    placed = placed.join(total, "_all", "left")
    ahead = F.col("rows_below") if metric in LOWER_IS_BETTER else F.col("_valued") - F.col("rows_below") - F.col("rows_equal")
    among = F.row_number().over(Window.partitionBy("_v").orderBy("run_id"))
    position = (F.coalesce(ahead, "_valued", F.lit(0)) + among).cast("int")
    return placed.withColumn("position", position).select(*runs.columns, "position")


def top_factor_models(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """The factors with the best holdout correlation; twelve decimals count, ties go by id."""
    best = fixed_point("holdout_correlation", 12)
    return metrics.orderBy(best.desc_nulls_last(), "factor_id").limit(limit)


def coverage_by_month(predictions: DataFrame) -> DataFrame:
    """Number of (run, period) observations per calendar month."""
    return (
        predictions.where(F.col("date").isNotNull()).groupBy("run_id", "date").agg(F.lit(1).alias("one"))
        .groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("run_observations"))
    )


def feature_family_uses(features: DataFrame) -> DataFrame:
    """Feature uses per name prefix; names without an underscore count as other."""
    name = F.col("feature")
    family = F.when(F.instr(name, "_") > 0, F.substring_index(name, "_", 1)).otherwise("other")
    return features.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("feature_uses"))


def promotion_by_state(runs: DataFrame, metric: str = VALIDATION_METRIC) -> DataFrame:
    """Dead runs are not promoted, successful ones with the metric are, all others wait."""
    status = (
        F.when(F.col("status").isin(*DEAD_STATES), "not promoted")
        .when(F.col("status").isin(*PROMOTED_STATES) & F.col(metric).isNotNull(), "promoted").otherwise("pending")
    )
    return runs.withColumn("promotion_status", status)


def promotion_by_threshold(
    runs: DataFrame, thresholds: Mapping[str, float | None], *, succeeded: Column | None = None
) -> DataFrame:
    """Required metrics are tried in order: the first missing one leaves the run pending, the
    first one below its threshold rejects it."""
    status = F.lit(None).cast("string")
    outcome = F.when(~(succeeded if succeeded is not None else F.lit(True)), "not promoted")
    for name, threshold in thresholds.items():
        if threshold is None or name not in runs.columns:
            outcome = outcome.when(F.lit(True), "pending")
            break
        outcome = outcome.when(F.col(name).isNull(), "pending").when(F.col(name) < float(threshold), "not promoted")
    else:
        status = F.lit("promoted")
    return runs.withColumn("promotion_status", F.coalesce(outcome, status))


def run_set_fingerprint(runs: DataFrame, value: str = "repro_hash") -> DataFrame:
    """First 16 hex digits of the hash over the sorted run hashes; one row per run goes in.

    The value is a hash of one joined string, so all hashes meet in one array in one task.  An
    array of strings takes at most 2**31 bytes and a hash of 16 characters takes 24 of them, so
    89 million runs are the upper bound; an executor's heap sets a lower one (not measured).
    """
    joined = F.concat_ws("|", F.array_sort(F.collect_list(F.col(value))))
    return runs.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("run_set_hash16"))


# --- analysis after a run --------------------------------------------------------------

def yearly_returns(portfolio: DataFrame) -> DataFrame:
    return portfolio.groupBy("split", F.year("formation_date").alias("year")).agg(
        (F.product(F.coalesce("portfolio_return", F.lit(0.0)) + 1) - 1).alias("year_return"),
        F.count(F.lit(1)).alias("months"),
    )


def worst_months(portfolio: DataFrame, count: int = 4) -> DataFrame:
    lowest = Window.partitionBy("split").orderBy(F.col("portfolio_return").asc_nulls_last(), "formation_date")
    return portfolio.withColumn("position", F.row_number().over(lowest)).where(F.col("position") <= count)


def cost_break_even(portfolio: DataFrame) -> DataFrame:
    """Mean return, mean turnover and the cost per turnover that uses the return up."""
    return portfolio.groupBy("split").agg(
        F.avg("portfolio_return").alias("mean_return"), F.avg("turnover").alias("mean_turnover"),
        F.try_divide(F.avg("portfolio_return"), F.avg("turnover")).alias("break_even_cost"),
    )


def leg_contribution(legs: DataFrame) -> DataFrame:
    """Mean forward return and score of each leg over all its member months."""
    return legs.groupBy("split", "leg").agg(
        F.avg("forward_return").alias("mean_forward_return"), F.avg("stock_score").alias("mean_score"),
        F.count(F.lit(1)).alias("members"),
    )


def score_gap(legs: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Mean score distance of the legs, and its correlation with the month's return."""
    side = {n: F.avg(F.when(F.col("leg") == n, F.col("stock_score"))) for n in ("long", "short")}
    gaps = legs.groupBy("formation_date", "split").agg((side["long"] - side["short"]).alias("gap"))
    joined = gaps.join(portfolio.select("formation_date", "split", "portfolio_return"), ["formation_date", "split"])
    return joined.groupBy("split").agg(
        F.avg("gap").alias("mean_score_gap"),
        guarded_correlation(F.col("gap"), F.col("portfolio_return")).alias("gap_return_correlation"),
    )


def concentration_effect(portfolio: DataFrame) -> DataFrame:
    """Mean return of months above and below the median concentration; one row per month in.

    Ten decimals count, so that months with the same weights fall on the same side."""
    rows = portfolio.withColumn("_h", fixed_point("mean_herfindahl_weight", 10))
    median = F.median("_h").over(Window.partitionBy("split"))
    high = F.when(F.col("_h") >= median, "high").otherwise("low")
    return rows.withColumn("concentration", high).groupBy("split", "concentration").agg(
        F.avg("portfolio_return").alias("mean_return"), F.count(F.lit(1)).alias("months")
    )


def factor_weight_means(allocations: DataFrame) -> DataFrame:
    return allocations.groupBy("split", "factor_id").agg(
        F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight")
    )


def weight_skill_correlation(allocations: DataFrame, model_metrics: DataFrame) -> DataFrame:
    """Do factors with more weight forecast better in the holdout?"""
    means = factor_weight_means(allocations).join(
        model_metrics.select("factor_id", "holdout_correlation"), "factor_id"
    )
    return means.groupBy("split").agg(
        guarded_correlation(F.col("mean_weight"), F.col("holdout_correlation")).alias("weight_skill_correlation")
    )
