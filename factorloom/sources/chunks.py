"""Tables written in chunks of dates that survive a broken-off run.

A chunk is a run of consecutive dates.  Its rows replace the partitions of its dates (dynamic partition overwrite), each
date in as many parts as its rows ask for.  Only when the write has ended, the chunk is entered in the manifest
folder beside the table, one small file a chunk.  A run that starts again plans the same chunks, skips those
that are entered under the same plan, and writes the others; what a broken-off chunk left is replaced.
Readers see the dates of entered chunks only.

The plan holds the dates with their row counts and a tag of the caller for whatever else decides the content; if either
changes, the chunk is written anew.  Rows without date belong to no chunk and are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import HORIZONS, cap_rows, check_labels, monthly_panel
from ..plans.staging import fixed_table, stage
from .contracts import require_columns
from .files import _filesystem

DATE = "formation_date"
_ENTRY = "chunk int, plan string, first_date date, last_date date, dates int, rows long"


@dataclass(frozen=True)
class Chunk:
    number: int
    dates: tuple
    rows: int
    plan: str


def plan_chunks(
    source: DataFrame, *, dates_per_chunk: int = 12, tag: str = "", most_rows: int | None = None, rows_per_row: int = 1
) -> list[Chunk]:
    """Chunks of consecutive dates, oldest first: one entry for each calendar date comes to the driver.

    ``rows_per_row`` is how many rows one row of the source becomes; a chunk of more than ``most_rows`` is refused
    before anything is written.
    """
    if dates_per_chunk < 1:
        raise ValueError("a chunk has at least one date")
    counts = [(r[DATE], r["n"]) for r in source.groupBy(DATE).agg(F.count(F.lit(1)).alias("n")).orderBy(DATE).collect()]
    if counts and counts[0][0] is None:
        raise ValueError(f"{counts[0][1]} rows without {DATE}")
    chunks = []
    for number, at in enumerate(range(0, len(counts), dates_per_chunk)):
        part = counts[at: at + dates_per_chunk]
        rows = sum(n for _, n in part) * rows_per_row
        if most_rows is not None and rows > most_rows:
            raise ValueError(f"chunk {number} ({part[0][0]} to {part[-1][0]}) has {rows} rows, more than {most_rows}; use fewer dates a chunk")
        plan = "|".join([tag, *(f"{d}:{n}" for d, n in part)])
        chunks.append(Chunk(number, tuple(d for d, _ in part), rows, plan))
    return chunks


def _table(location: str) -> str:
    return f"{location.rstrip('/')}/table"


def _manifest(location: str) -> str:
    return f"{location.rstrip('/')}/chunks"


def entered_chunks(spark: SparkSession, location: str) -> DataFrame:
    """The manifest: chunk, plan, first and last date, dates and rows of each finished chunk."""
    fs, path = _filesystem(spark, _manifest(location))
    if not fs.exists(path):
        return spark.createDataFrame([], _ENTRY)
    # a write that broke off has left no file with rows
    return spark.read.schema(_ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(_manifest(location))


def write_chunks(
    source: DataFrame, location: str, *, make: Callable[[DataFrame], DataFrame] | None = None, dates_per_chunk: int = 12,
    rows_per_part: int = 4_000_000, sort: Sequence[str] = (), tag: str = "", most_rows: int | None = None, rows_per_row: int = 1,
    before_chunk: Callable[[Chunk], None] | None = None,
) -> list[Chunk]:
    """Write ``make`` of the source's rows chunk by chunk; gives the chunks that this run wrote.

    ``make`` turns the rows of some whole dates into result rows of the same dates, such as scores of a panel.
    ``before_chunk`` is called with each chunk that is about to be written.
    """
    spark = source.sparkSession
    require_columns(source, [DATE], "chunked table")
    chunks = plan_chunks(source, dates_per_chunk=dates_per_chunk, tag=tag, most_rows=most_rows, rows_per_row=rows_per_row)
    done = {(r["chunk"], r["plan"]) for r in entered_chunks(spark, location).collect()}
    written = []
    for chunk in chunks:
        if (chunk.number, chunk.plan) in done:
            continue
        if before_chunk:
            before_chunk(chunk)
        rows = source.where(F.col(DATE).isin(list(chunk.dates)))
        rows = make(rows) if make else rows
        # a date is cut into parts of about the same size, chosen by its own count
        parts = F.ceil(F.count(F.lit(1)) * 1.0 / rows_per_part).cast("int")
        rows = stage(rows, "chunk-rows")
        sizes = rows.groupBy(F.col(DATE).alias("of_date")).agg(parts.alias("parts"))
        dealt = rows.join(sizes, F.col(DATE) == F.col("of_date"))
        # by content, so that a task that is run again deals its rows the same way
        place = F.pmod(F.xxhash64(*rows.columns), F.col("parts")).cast("int")
        dealt = dealt.withColumn("_part", place).repartition(DATE, "_part").sortWithinPartitions(DATE, *sort)
        dealt.drop("of_date", "parts", "_part").write.mode("overwrite").options(
            partitionOverwriteMode="dynamic", maxRecordsPerFile=rows_per_part
        ).partitionBy(DATE).parquet(_table(location))
        entry = fixed_table(spark, [(chunk.number, chunk.plan, chunk.dates[0], chunk.dates[-1], len(chunk.dates), chunk.rows)], _ENTRY)
        entry.coalesce(1).write.mode("overwrite").json(f"{_manifest(location)}/{chunk.number:06d}")
        written.append(chunk)
    return written


def read_chunks(spark: SparkSession, location: str) -> DataFrame:
    """The rows of all finished chunks; parts of a chunk that broke off are not seen."""
    spans = entered_chunks(spark, location).select("first_date", "last_date").collect()  # one row a chunk
    if not spans:
        raise FileNotFoundError(f"no finished chunk under {location}")
    # on the partition column, so the scan skips the other dates
    finished = None
    for first, last in sorted(map(tuple, spans)):
        here = F.col(DATE).between(F.lit(first), F.lit(last))
        finished = here if finished is None else finished | here
    return spark.read.parquet(_table(location)).where(finished)


def label_stage(
    monthly: DataFrame, names: DataFrame, location: str, *, start: str | None = None, end: str | None = None,
    horizons: Sequence[int] = HORIZONS, min_market_cap: float | None = None, max_rows: int = 0,
    row_cap_mode: str = "date-balanced", dates_per_chunk: int = 12,
) -> tuple[DataFrame, DataFrame]:
    """Universe, forward returns, row cap, label checks and sink in one: the written panel and the validation row.

    Nothing is written unless the labels pass their checks.  A second call with the same input goes on where the
    first broke off.
    """
    panel = monthly_panel(monthly, names, start=start, end=end, horizons=horizons, min_market_cap=min_market_cap)
    panel = stage(cap_rows(panel, max_rows, row_cap_mode), "label-panel")
    checked = check_labels(panel).withColumns({"max_rows": F.lit(max_rows), "row_cap_mode": F.lit(row_cap_mode)})
    tag = f"labels {start} {end} {tuple(horizons)} {min_market_cap} {max_rows} {row_cap_mode}"
    write_chunks(panel, location, dates_per_chunk=dates_per_chunk, sort=["permno"], tag=tag)
    return read_chunks(panel.sparkSession, location).select(*panel.columns), checked
