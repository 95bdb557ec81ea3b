"""Stock-score portfolios of many splits at once.

With many splits a table of one score for each security, date and split is a large multiple of the panel.  Here a
security and date is one row that holds its signals, and each task adds up the scores of all splits where
it needs them, always in the same order, so that equal sums stay equal.  Three passes over these rows give the returns:
counts of the scores in cells, the scores inside the cells of the wanted ranks, and the sums of the two legs.  Weights, cells
and cuts go to the tasks as small arrays of each date, whose size is given by splits and signals, not by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.orderstats import pick_ranked, quantile_position
from ..plans.shipping import ship_package
from ..plans.staging import stage
from ..sources.contracts import require_columns
from .portfolio import SLICE, signal_weights

#: Lower bits of a score that its cell leaves out: sign, exponent and 5 bits of the mantissa are kept.
CELL_SHIFT = 47
NO_CELL = np.iinfo(np.int64).min


def score_cells(scores: np.ndarray) -> np.ndarray:
    """Order-keeping cell numbers of doubles; -0.0 lies with 0.0."""
    bits = (scores + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits) >> CELL_SHIFT


def _count_cells(scores: np.ndarray, _returns, _known) -> list[np.ndarray]:
    cells = score_cells(scores)
    low = int(cells.min())
    width = int(cells.max()) - low + 1
    flat = (np.arange(scores.shape[1]) * width + (cells - low))[~np.isnan(scores)]
    if scores.shape[1] * width <= 4 * max(flat.size, 1):
        counts = np.bincount(flat, minlength=1)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(flat, return_counts=True)
    return [(found // width).astype(np.int32), found % width + low, counts.astype(np.int64)]


def _inside_cells(scores: np.ndarray, _returns, known) -> list[np.ndarray]:
    cells = score_cells(scores)
    wanted = np.zeros(scores.shape, bool)
    for some in known:
        wanted |= cells == some
    at, split = np.nonzero(wanted & ~np.isnan(scores))
    return [split.astype(np.int32), cells[at, split], scores[at, split]]


def _leg_sums(scores: np.ndarray, returns: np.ndarray, known) -> list[np.ndarray]:
    out = [np.arange(scores.shape[1], dtype=np.int32)]
    for leg in (scores >= known[0], scores <= known[1]):
        out += [np.where(leg, returns[:, None], 0.0).sum(axis=0), leg.sum(axis=0).astype(np.int64)]
    return out


def _by_date(rows: list, shape: tuple[int, int], empty, kind) -> dict:
    """Arrays of each date from (date, line, split, value)."""
    found: dict = {}
    for day, line, split, value in rows:
        if value is not None:
            found.setdefault(day, np.full(shape, empty, kind))[line, split] = value
    return found


def qspread_returns(
    allocations: DataFrame, signals: DataFrame, registry: DataFrame, panel: DataFrame, names: Sequence[str], *,
    return_column: str = "ret_1m_fwd", leg_quantile: float = 0.10,
) -> DataFrame:
    """(formation_date, split, portfolio_return), as of ``qspread_portfolio`` over ``qspread_members``.

    ``names`` are the signals in the order in which their weighted scores are added.
    """
    require_columns(panel, ["formation_date", "permno", return_column], "panel")
    spark, names = panel.sparkSession, list(names)
    count = len(names)
    weights = stage(signal_weights(allocations, registry).select(*SLICE, "signal", "w_sum"), "sweep_weights")
    # dates x splits x signals: bounded by the calendar and the grid
    held = weights.collect()
    splits = sorted({r["split"] for r in held})
    at_split, at_signal = {s: k for k, s in enumerate(splits)}, {s: k for k, s in enumerate(names)}
    shape = (count, len(splits))
    placed = [(r["formation_date"], at_signal[r["signal"]], at_split[r["split"]], r["w_sum"]) for r in held]
    summed = _by_date(placed, shape, 0.0, float)
    present = _by_date([(*p[:3], 1.0) for p in placed], shape, 0.0, float)
    weighed = spark.sparkContext.broadcast({day: (summed.get(day, np.zeros(shape)), has) for day, has in present.items()})

    of_signal = [F.max(F.when(F.col("signal") == n, F.col("factor_score").cast("double"))).alias(f"s{k}") for k, n in enumerate(names)]
    dates = weights.select("formation_date").distinct()
    wide = signals.select("formation_date", "permno", "signal", "factor_score").join(dates, "formation_date", "left_semi")
    realised = panel.select("formation_date", "permno", F.col(return_column).cast("double").alias("r")).where("r IS NOT NULL")
    rows = wide.groupBy("formation_date", "permno").agg(*of_signal).join(realised, ["formation_date", "permno"]).drop("permno")
    rows = stage(rows.sortWithinPartitions("formation_date"), "sweep_rows")  # batches of few dates
    ship_package(spark)

    def scored(batch):
        """Date, scores (NaN for a security without any signal of the split) and returns of each date of a batch."""
        days = batch.column(0)
        codes = days.cast(pa.int32()).to_numpy()
        x = np.column_stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(count)])
        returns = batch.column(1 + count).to_numpy(zero_copy_only=False)
        for code in np.unique(codes):
            here = np.flatnonzero(codes == code)
            w, has = weighed.value[days[int(here[0])].as_py()]
            seen = ~np.isnan(x[here])
            filled = np.where(seen, x[here], 0.0)
            scores = np.zeros((len(here), len(splits)))
            for k in np.flatnonzero(has.any(axis=1)):
                scores += filled[:, k, None] * w[k]
            scores[(seen.astype(float) @ has) == 0] = np.nan
            yield days[int(here[0])].as_py(), scores, returns[here]

    def told(make: Callable, kinds: str, known=None) -> DataFrame:
        labels = ["formation_date", *[k.split()[0] for k in kinds.split(", ")]]

        def run(batches):
            for batch in batches:
                for day, scores, returns in scored(batch):
                    if known is not None and day not in known.value:
                        continue
                    made = make(scores, returns, None if known is None else known.value[day])
                    yield pa.record_batch([pa.array([day] * len(made[0]), pa.date32()), *[pa.array(m) for m in made]], labels)

        return rows.mapInArrow(run, f"formation_date date, {kinds}")

    group = ["formation_date", "at"]
    cells = told(_count_cells, "at int, cell long, n long").groupBy(*group, "cell").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({"through": F.sum("n").over(in_order), "size": F.sum("n").over(Window.partitionBy(*group))})
    quantiles = {"long": 1.0 - leg_quantile, "short": leg_quantile}
    picks = [f"{leg}_{end}" for leg in quantiles for end in ("low", "high")]
    ranks = [
        F.struct(F.lit(f"{leg}_{end}").alias("pick"), near(quantile_position(F.col("size"), q)).cast("long").alias("rank"))
        for leg, q in quantiles.items() for end, near in (("low", F.floor), ("high", F.ceil))
    ]
    before = F.col("through") - F.col("n")
    targets = cells.withColumn("w", F.explode(F.array(*ranks))).where((F.col("w.rank") >= before) & (F.col("w.rank") < F.col("through")))
    targets = stage(targets.select(*group, "cell", "size", "w.pick", (F.col("w.rank") - before).alias("rank")), "sweep_targets")

    # dates x splits x four ranks
    at_pick = {p: k for k, p in enumerate(picks)}
    wanted = [(r["formation_date"], at_pick[r["pick"]], r["at"], r["cell"]) for r in targets.collect()]
    known = spark.sparkContext.broadcast(_by_date(wanted, (len(picks), len(splits)), NO_CELL, np.int64))
    inside = stage(told(_inside_cells, "at int, cell long, score double", known), "sweep_inside")
    info = targets.groupBy(*group, "cell").agg(*[F.max(F.when(F.col("pick") == p, F.col("rank"))).alias(p) for p in picks])
    found = pick_ranked(inside, [*group, "cell"], "score", {p: lambda n, p=p: F.col(p) for p in picks}, group_info=info)
    cuts = found.groupBy(*group).agg(*[F.max(F.when(F.col("pick") == p, F.col("value"))).alias(p) for p in picks])
    cuts = cuts.join(targets.select(*group, "size").distinct(), group)
    at_cut = []
    for leg, q in quantiles.items():
        place = quantile_position(F.col("size"), q)
        low, high = F.col(f"{leg}_low"), F.col(f"{leg}_high")
        at_cut.append((low + (high - low) * (place - F.floor(place))).alias(leg))
    cut = [(r["formation_date"], k, r["at"], r[leg]) for r in cuts.select(*group, *at_cut).collect() for k, leg in enumerate(quantiles)]
    known = spark.sparkContext.broadcast(_by_date(cut, (len(quantiles), len(splits)), np.nan, float))
    legs = told(_leg_sums, "at int, long_sum double, long_n long, short_sum double, short_n long", known)
    sums = legs.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("long_sum", "long_n", "short_sum", "short_n")])
    returned = F.col("long_sum") / F.nullif(F.col("long_n"), F.lit(0)) - F.col("short_sum") / F.nullif(F.col("short_n"), F.lit(0))
    return sums.where("long_n + short_n > 0").select(
        "formation_date", F.get(F.array(*[F.lit(s) for s in splits]), F.col("at")).alias("split"), returned.alias("portfolio_return")
    )
