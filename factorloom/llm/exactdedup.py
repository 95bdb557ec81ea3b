"""Exact deduplication with streaming state.

The narrow arrivals (digest, identifier, place of the content) run through a streaming aggregation whose
state lies in an embedded disk store, has no expiry and keeps for each digest the retained identifier,
its content's place and the number of arrivals.  Partial aggregation before the shuffle folds the copies
of a hot text.  Rows whose digest was hit more than once are then compared with the retained content byte
for byte; a row that differs is grouped by its own text.

Among equal texts the row with the largest identifier stays (of repeated rows with that identifier one
stays, null identifiers come last).  Null texts count as empty, so they are equal to each other and to
empty ones.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.located import FILE, PLACE, ROW, given_back, held as held_column, with_place
from factorloom.plans.staging import stage, stage_root

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # close each store after its commit: open stores hold several MB of disk and memory each
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def retained_state(arrivals: DataFrame) -> DataFrame:
    """Rows (digest, held, arrived): state after all arrivals (digest, id, file, row) went through the stream."""
    spark = arrivals.sparkSession
    folder = f"{stage_root(spark)}/dedup-{uuid.uuid4().hex}"
    written = f"{folder}/arrivals"
    arrivals.write.parquet(written)
    stream = spark.readStream.schema(arrivals.schema).parquet(written)
    state = stream.groupBy("digest").agg(
        F.max(F.struct("id", FILE, ROW)).alias("held"), F.count(F.lit(1)).alias("arrived")
    )
    out = f"{folder}/state"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {key: spark.conf.get(key) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    if not query.recentProgress or not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], state.schema)
    updates = spark.read.schema(state.schema.add("batch", "long")).parquet(out)
    latest = updates.groupBy("digest").agg(F.max_by(F.struct("held", "arrived"), "batch").alias("last"))
    return latest.select("digest", "last.held", "last.arrived")


def duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex
) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, digest) and the row's place, one for each row of ``docs``."""
    return _classes(with_place(docs), id_col, text_col, digest)


def _classes(placed: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    content = F.coalesce(held_column(text_col), F.lit(""))
    rows = placed.select(held_column(id_col).alias("id"), content.alias("content"), *PLACE)
    rows = rows.withColumn("digest", digest(F.col("content")))
    arrivals = stage(rows.drop("content"), "dedup-digests")
    state = stage(retained_state(arrivals), "dedup-state")

    alone = arrivals.join(state.filter("arrived = 1").select("digest"), "digest").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", *PLACE
    )
    hits = stage(rows.join(state.filter("arrived > 1").select("digest", "held"), "digest"), "dedup-hits")
    is_held = (F.col(FILE) == F.col(f"held.{FILE}")) & (F.col(ROW) == F.col(f"held.{ROW}"))
    held = hits.filter(is_held).select("digest", F.col("content").alias("held_content"))
    differs = F.col("content") != F.col("held_content")
    checked = stage(
        hits.join(held, "digest").select("id", "digest", *PLACE, F.when(differs, F.col("content")).alias("other")), "dedup-checked"
    )
    classes = checked.groupBy("digest", "other").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = _with_class(checked, classes)
    first = grouped.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "other").agg(
        F.min(F.struct(*PLACE)).alias("stays")
    )
    together = _with_class(grouped, first).select(
        "id", "keep_id", "group_size", (F.struct(*PLACE) == F.col("stays")).alias("kept"), "digest", *PLACE
    )
    return alone.unionByName(together).withColumnRenamed("id", id_col)


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    named = classes.withColumnsRenamed({"digest": "class_digest", "other": "class_other"})
    on = (F.col("digest") == F.col("class_digest")) & F.col("other").eqNullSafe(F.col("class_other"))
    return rows.join(named, on).drop("class_digest", "class_other")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    placed = with_place(docs)
    kept = _classes(placed, id_col, text_col, sha256_hex).filter("kept").select(*PLACE)
    return given_back(placed.join(kept, list(PLACE), "left_semi"))
