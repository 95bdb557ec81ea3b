"""Queries over the event history of research jobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import fixed_table

# From each state, the states a job may move to.
LEGAL_TRANSITIONS: dict[str, tuple[str, ...]] = {
    "PROPOSED": ("QUEUED", "FAILED", "REJECTED"),
    "QUEUED": ("CLAIMED", "FAILED", "REJECTED"),
    "CLAIMED": ("QUEUED", "RUNNING", "FAILED", "REJECTED"),
    "RUNNING": ("QUEUED", "EVALUATING", "FAILED", "REJECTED"),
    "EVALUATING": ("PERSISTING", "FAILED", "REJECTED"),
    "PERSISTING": ("RENDERING", "FAILED", "REJECTED"),
    "RENDERING": ("SUCCEEDED", "FAILED", "REJECTED"),
    "SUCCEEDED": ("FAILED", "REJECTED"),
    "REJECTED": ("FAILED",),
    "FAILED": ("QUEUED", "DEAD_LETTER", "REJECTED"),
    "DEAD_LETTER": ("FAILED", "REJECTED"),
}
LEASE_STATES = ("CLAIMED", "RUNNING")
TERMINAL_STATES = ("SUCCEEDED", "FAILED", "DEAD_LETTER")

# Event numbers per block when a job's history is read in order.
BLOCK = 1_000_000


def transition_table(spark: SparkSession) -> DataFrame:
    pairs = [(a, b) for a, targets in LEGAL_TRANSITIONS.items() for b in targets]
    return fixed_table(spark, pairs, "from_state string, to_state string")


def current_state(events: DataFrame) -> DataFrame:
    """State after the last event of each job that names one; combines before the shuffle."""
    moved = events.where(F.col("to_state").isNotNull())
    return moved.groupBy("job_id").agg(
        F.max_by("to_state", "event_id").alias("state"), F.max("event_id").alias("last_event_id"),
        F.count(F.lit(1)).alias("events"),
    )


def with_previous_state(events: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Add the state of the job's preceding event.

    One job may own much of the history, so its events are not sorted as one group: they are
    read in blocks of event numbers, and the first event of a block takes the last state of
    the job's preceding block.  Event numbers are unique, which bounds a block.
    """
    rows = events.withColumn("_block", F.floor(F.col("event_id") / block))
    ends = rows.groupBy("job_id", "_block").agg(F.max_by("to_state", "event_id").alias("_end"))
    before = ends.select(
        "job_id", "_block", F.lag("_end").over(Window.partitionBy("job_id").orderBy("_block")).alias("_before")
    )
    within = F.lag("to_state").over(Window.partitionBy("job_id", "_block").orderBy("event_id"))
    first = F.row_number().over(Window.partitionBy("job_id", "_block").orderBy("event_id")) == 1
    stepped = rows.withColumns({"_within": within, "_first": first})
    joined = stepped.join(before, ["job_id", "_block"])
    previous = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_within"))
    return joined.withColumn("previous_state", previous).drop("_block", "_within", "_first", "_before")


def transition_audit(events: DataFrame) -> DataFrame:
    """Events with a verdict: initial, legal, illegal, or discontinuous where a stated
    from_state differs from the state before."""
    legal = transition_table(events.sparkSession).select(
        F.col("from_state").alias("previous_state"), "to_state", F.lit(True).alias("allowed")
    )
    stepped = with_previous_state(events).join(legal, ["previous_state", "to_state"], "left")
    verdict = F.when(F.col("previous_state").isNull(), "initial")
    if "from_state" in events.columns:
        verdict = verdict.when(~F.col("from_state").eqNullSafe(F.col("previous_state")), "discontinuous")
    return stepped.withColumn("verdict", verdict.when(F.col("allowed"), "legal").otherwise("illegal")).drop("allowed")


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("previous_state", "to_state", "verdict").agg(F.count(F.lit(1)).alias("events"))


def expired_leases(leases: DataFrame, states: DataFrame, now) -> DataFrame:
    """Leases that ended by ``now`` of jobs still claimed or running."""
    open_jobs = states.where(F.col("state").isin(*LEASE_STATES)).select("job_id", "state")
    return leases.where(F.col("expires_at") <= F.lit(now)).join(open_jobs, "job_id")


def leases_from_events(events: DataFrame, *, minutes: int = 60) -> DataFrame:
    """A lease runs from the job's last claiming or running event."""
    held = events.where(F.col("to_state").isin(*LEASE_STATES))
    last = held.groupBy("job_id").agg(F.max("occurred_at").alias("claimed_at"))
    return last.withColumn("expires_at", F.col("claimed_at") + F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def dead_letters(events: DataFrame, states: DataFrame) -> DataFrame:
    """Jobs in the dead-letter state, with the event that brought them there as the reason and
    the number of failures before as retries.  A job that merely failed is not listed."""
    dead = states.where(F.col("state") == "DEAD_LETTER").select("job_id", "state")
    entered = F.when(F.col("to_state") == "DEAD_LETTER", F.col("event_id"))
    history = events.where(F.col("to_state").isin("FAILED", "DEAD_LETTER")).groupBy("job_id").agg(
        F.max_by("event_type", entered).alias("reason"), F.count_if(F.col("to_state") == "FAILED").alias("retry_count"),
        F.max_by("occurred_at", entered).alias("failed_at"),
    )
    return history.join(dead, "job_id")


def trial_budget(
    states: DataFrame, *, hard_cap: int, best_metrics: Mapping[str, float] | None = None,
    thresholds: Mapping[str, float] | None = None, plateau_threshold: float = 0.005,
    weights: tuple[float, float, float] = (0.3, 0.4, 0.3),
) -> DataFrame:
    """Queue share, failure rate and improvement share, and the number of trials they allow."""
    queued = F.count_if(F.col("state") == "QUEUED").cast("double")
    ended = F.count_if(F.col("state").isin(*TERMINAL_STATES)).cast("double")
    failed = F.count_if(F.col("state").isin("FAILED", "DEAD_LETTER")).cast("double")
    shared = {k: v for k, v in (best_metrics or {}).items() if k in (thresholds or {})}
    improved = sum(v > thresholds[k] + plateau_threshold for k, v in shared.items()) / len(shared) if shared else 1.0
    w_queue, w_failure, w_plateau = weights
    row = states.agg(
        F.count(F.lit(1)).alias("jobs"),
        (1 - F.coalesce(F.try_divide(queued, F.count(F.lit(1))), F.lit(0.0))).alias("queue_factor"),
        F.coalesce(F.try_divide(failed, ended), F.lit(0.0)).alias("failure_rate"),
    ).withColumn("plateau_factor", F.lit(float(improved)))
    adjustment = (
        w_queue * F.col("queue_factor") + w_failure * (1 - F.col("failure_rate")) + w_plateau * F.col("plateau_factor")
    )
    trials = F.greatest(F.lit(1), F.least(F.lit(hard_cap), F.bround(F.lit(hard_cap) * adjustment).cast("int")))
    return row.withColumns({"adjustment": adjustment, "trial_count": trials})
