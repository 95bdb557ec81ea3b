"""A tree of hashes over a set of run hashes, and what differs between two sets.

`reports.run_set_fingerprint` is one hash over one joined text of all runs.  Here the values
are grouped into ranges by the first hex digits of their own hash; a leaf is the hash of the
sorted values of its range with their numbers of copies, an inner node the hash of its at most
16 children, and node '' stands for the whole set.  Equal sets have equal trees under any
partitioning.  Two sets are compared node by node, and values are looked at only in the ranges
whose leaves differ.

No array holds more than one range's different values, about 1/16**depth of them, as the
ranges are cut by a hash and copies are counted first.  The tree has at most 16**(depth+1)/15
nodes.  A missing value is a value of its own; a set without rows has no node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

DEPTH = 4


def _counted(rows: DataFrame, value: str, depth: int) -> DataFrame:
    """Rows (node, item, copies): each different value once, with the leaf it belongs to."""
    text = F.col(value).cast("string")
    item = F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), text))
    counted = rows.select(item.alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("copies"))
    return counted.select(F.substring(F.sha2("item", 256), 1, depth).alias("node"), "item", "copies")


def _hash_of(text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(text))), 256)


def _levels(counted: DataFrame, depth: int) -> DataFrame:
    entry = F.concat("item", F.lit(":"), F.col("copies").cast("string"))
    leaves = counted.groupBy("node").agg(_hash_of(entry).alias("hash"), F.sum("copies").alias("rows"))
    levels = [stage(leaves.withColumn("level", F.lit(depth)), "hash_leaves")]
    for level in range(depth - 1, -1, -1):
        children = levels[-1].withColumn("parent", F.substring("node", 1, level))
        child = F.concat("node", F.lit(":"), F.col("hash"))
        levels.append(
            children.groupBy("parent").agg(_hash_of(child).alias("hash"), F.sum("rows").alias("rows"))
            .select(F.col("parent").alias("node"), "hash", "rows", F.lit(level).alias("level"))
        )
    return reduce(DataFrame.unionByName, levels)


def hash_tree(runs: DataFrame, value: str = "repro_hash", *, depth: int = DEPTH) -> DataFrame:
    """Rows (level, node, rows, hash) of the tree; ``node`` is the hash prefix of its range."""
    return _levels(_counted(runs, value, depth), depth).select("level", "node", "rows", "hash")


def differing_ranges(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes of two trees of the same depth whose hashes differ; a missing node counts as no rows."""
    a = ours.select("level", "node", F.col("rows").alias("our_rows"), F.col("hash").alias("our_hash"))
    b = theirs.select("level", "node", F.col("rows").alias("their_rows"), F.col("hash").alias("their_hash"))
    joined = a.join(b, ["level", "node"], "full").where(~F.col("our_hash").eqNullSafe(F.col("their_hash")))
    zero = F.lit(0).cast("long")
    return joined.select(
        "level", "node", F.coalesce("our_rows", zero).alias("our_rows"), F.coalesce("their_rows", zero).alias("their_rows")
    )


def differing_values(ours: DataFrame, theirs: DataFrame, value: str = "repro_hash", *, depth: int = DEPTH) -> DataFrame:
    """Rows (node, value, our_copies, their_copies) of the values that one set holds more often.

    The leaves are compared first; only the values of the ranges that differ are joined.
    """
    sides = [stage(_counted(side, value, depth), "hash_values") for side in (ours, theirs)]
    leaves = [_levels(side, depth).where(F.col("level") == depth) for side in sides]
    open_ranges = stage(differing_ranges(*leaves).select("node"), "open_ranges")
    a, b = (side.join(open_ranges, "node", "left_semi") for side in sides)
    joined = a.withColumnRenamed("copies", "our_copies").join(
        b.withColumnRenamed("copies", "their_copies"), ["node", "item"], "full"
    )
    zero = F.lit(0).cast("long")
    counts = joined.withColumns({c: F.coalesce(c, zero) for c in ("our_copies", "their_copies")})
    text = F.when(F.col("item") != "n", F.substring("item", 2, 2**31 - 1))
    return counts.where(F.col("our_copies") != F.col("their_copies")).select(
        "node", text.alias(value), "our_copies", "their_copies"
    )
