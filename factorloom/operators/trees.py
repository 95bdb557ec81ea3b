"""Forests for every (factor, fold) at once.

The trees of all factors and folds grow together, level by level.  A table holds each training row once for each tree
that drew it, with its node; one aggregate over it gives the histogram (tree, node, feature, value) of a level, running
sums over the values of a node give the gain of every cut, and the best cut of each node moves the rows to
its children.  The rows to be predicted stand in the same table with weight 0 and follow the same cuts.  A level is one
job, however many trees there are, and nothing but the number of its cuts comes to the driver.

A cut sends values up to its threshold to the left.  The threshold is the middle between two neighbouring values of the
node, and the cut with the largest fall of squared error wins, ties to the first feature and the lowest value.
Extra-trees draw one threshold between the smallest and the largest value of each node and feature instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import folds as FD

KEY, DATE = FD.KEY, FD.DATE
UNIT = (KEY, "fold", "tree")
#: Gains are compared to so many decimals, so that the order of summation does not choose between equal cuts.
GAIN_DECIMALS = 12


def uniform(seed: int, *keys) -> Column:
    """A repeatable number from 0 up to 1 for each key."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**53)) / F.lit(float(2**53))


def drawn_times(seed: int, *keys) -> Column:
    """How often a bootstrap of as many rows draws a row: Poisson with mean 1, by the row's own hash."""
    shares = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(12)])
    u = uniform(seed, *keys)
    return sum((F.when(u >= float(s), 1).otherwise(0) for s in shares), F.lit(0))


def level_cuts(state: DataFrame, level: int, *, min_leaf: int, random_cuts: bool, seed: int) -> DataFrame:
    """Rows (unit, node, feature, threshold): the best cut of every node of a level that may be cut."""
    rows = state.where((F.col("w") > 0) & (F.col("node") >= 2**level))
    cells = rows.select(*UNIT, "node", "w", (F.col("w") * F.col("y")).alias("wy"), F.posexplode("x").alias("feature", "v"))
    cells = cells.groupBy(*UNIT, "node", "feature", "v").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("w").alias("n"), F.sum("wy").alias("s")
    )
    node = Window.partitionBy(*UNIT, "node", "feature")
    upward = node.orderBy("v")
    so_far = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumns({
        "rows_l": F.sum("rows").over(so_far), "n_l": F.sum("n").over(so_far), "s_l": F.sum("s").over(so_far),
        "rows_t": F.sum("rows").over(node), "n_t": F.sum("n").over(node), "s_t": F.sum("s").over(node), "next": F.lead("v").over(upward),
    })
    if random_cuts:
        low, high = F.min("v").over(node), F.max("v").over(node)
        cells = cells.withColumn("threshold", low + uniform(seed, *UNIT, "node", "feature") * (high - low))
        cells = cells.where((F.col("v") <= F.col("threshold")) & (F.col("next") > F.col("threshold")))
    else:
        # the middle of two neighbouring doubles may round to the upper one
        middle = F.col("v") + (F.col("next") - F.col("v")) / 2
        cells = cells.withColumn("threshold", F.when(middle < F.col("next"), middle).otherwise(F.col("v")))
    n_r, s_r = F.col("n_t") - F.col("n_l"), F.col("s_t") - F.col("s_l")
    gain = F.pow("s_l", F.lit(2)) / F.col("n_l") + F.pow(s_r, F.lit(2)) / n_r - F.pow("s_t", F.lit(2)) / F.col("n_t")
    can = cells.where(
        F.col("next").isNotNull() & (F.col("rows_l") >= min_leaf) & (F.col("rows_t") - F.col("rows_l") >= min_leaf)
    ).withColumn("gain", F.round(gain, GAIN_DECIMALS)).where("gain > 0")
    best = F.max_by(F.struct("feature", "threshold"), F.struct("gain", -F.col("feature"), -F.col("v")))
    return can.groupBy(*UNIT, "node").agg(best.alias("best")).select(*UNIT, "node", "best.feature", "best.threshold")


def grow(
    state: DataFrame, *, max_depth: int = 8, min_leaf: int = 20, random_cuts: bool = False, seed: int = 42
) -> tuple[DataFrame, list[DataFrame]]:
    """The table (unit, w, y, x, node = 1, ...) with the final node of every row, and the cuts of each level."""
    levels: list[DataFrame] = []
    for level in range(max_depth):
        cuts = stage(level_cuts(state, level, min_leaf=min_leaf, random_cuts=random_cuts, seed=seed), "tree-cuts")
        if not cuts.limit(1).count():
            break
        levels.append(cuts)
        right = (F.get("x", F.col("feature")) > F.col("threshold")).cast("long")
        child = F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)
        moved = state.join(cuts, [*UNIT, "node"], "left").withColumn("node", child).drop("feature", "threshold")
        state = stage(moved.select(*state.columns), "tree-rows")
    return state, levels


def forest_forecast(
    held: FD.FoldRows, *, trees: int = 100, max_depth: int = 8, min_leaf: int = 20, seed: int = 42,
    bootstrap: bool = True, random_cuts: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Mean prediction of a forest for all validation and test rows, and (factor, train_rows) summed over the folds."""
    features = list(held.features)
    _, gaps = FD.column_facts(held)
    train = held.rows.where("block < folds").withColumn("fold", F.explode(F.sequence("block", F.col("folds") - 1)))
    train = train.select(KEY, "fold", DATE, F.lit(None).cast("string").alias("role"), F.col(held.target).alias("y"), *features)
    ask = FD.evaluated(held).select(KEY, "fold", DATE, "role", F.lit(None).cast("double").alias("y"), *features)
    rows = train.unionByName(ask)
    if gaps:
        rows = rows.join(FD.fold_medians(held, gaps), [KEY, "fold"])
        # a column without any training value is the same for all rows
        rows = rows.withColumns({g: F.coalesce(g, F.get("medians", F.lit(k)), F.lit(0.0)) for k, g in enumerate(gaps)})
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    times = drawn_times(seed, *UNIT, DATE) if bootstrap else F.lit(1)
    rows = rows.withColumn("w", F.when(F.col("role").isNull(), times).otherwise(0).cast("double")).where("w > 0 OR role IS NOT NULL")
    state = rows.select(*UNIT, DATE, "role", "w", "y", F.array(*features).cast("array<double>").alias("x"), F.lit(1).cast("long").alias("node"))
    final, _ = grow(stage(state, "tree-rows"), max_depth=max_depth, min_leaf=min_leaf, random_cuts=random_cuts, seed=seed)
    leaves = final.where("w > 0").groupBy(*UNIT, "node").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"))
    asked = final.where(F.col("role").isNotNull()).select(*UNIT, DATE, "role", "node").join(leaves, [*UNIT, "node"])
    found = asked.groupBy(KEY, "fold", DATE, "role").agg(F.avg("value").alias("prediction"))
    fitted = FD.evaluated(held).select(KEY, "fold", DATE, "role", held.target).join(found, [KEY, "fold", DATE, "role"])
    return fitted.select(DATE, KEY, held.target, "role", "fold", "prediction"), FD.trained_rows(held)

