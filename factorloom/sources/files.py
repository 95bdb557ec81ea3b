"""Readers and writers: resolve raw tables, read prepared data, write run results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_date, nulled_nonfinite
from .contracts import CONTRACTS, Contract, date_profile, require_columns, require_unique

PANEL_KEY = ("permno", "formation_date")


def _filesystem(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def parquet_files(spark: SparkSession, location: str) -> list[str]:
    """Parquet files at a file or directly in a folder; other files are ignored."""
    fs, path = _filesystem(spark, location)
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path) if s.isFile()]
    return sorted(f for f in found if f.endswith(".parquet"))


def locate(spark: SparkSession, data_dir: str, contract: Contract) -> str | None:
    """First candidate location that holds parquet files."""
    for candidate in contract.locations:
        location = f"{data_dir.rstrip('/')}/{candidate}"
        if parquet_files(spark, location):
            return location
    return None


def _coerced(df: DataFrame, contract: Contract) -> DataFrame:
    """Cast the contract's columns that are present; extra columns stay as they are."""
    wanted = {f.name: f.dataType for f in contract.schema.fields}
    columns = []
    for field in df.schema.fields:
        target = wanted.get(field.name)
        if target is None or target == field.dataType:
            columns.append(F.col(field.name))
        elif isinstance(target, T.DateType):
            columns.append(as_date(df, field.name).alias(field.name))
        else:
            columns.append(F.col(field.name).try_cast(target).alias(field.name))
    return nulled_nonfinite(df.select(*columns))


def read_parquet(spark: SparkSession, location: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a file or a folder of parquet files; a schema also covers files whose column is
    entirely null and was therefore written with another type."""
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(location)


def read_contract(spark: SparkSession, location: str, contract: Contract) -> DataFrame:
    """A table in the contract's types.

    Files of one folder may differ in a column's type, as a year without any value is often
    written with another one; files of one schema are read together and cast before the union.
    """
    by_schema: dict[str, list[str]] = {}
    for file in parquet_files(spark, location) or [location]:
        by_schema.setdefault(spark.read.parquet(file).schema.simpleString(), []).append(file)
    if len(by_schema) <= 1:
        return _coerced(read_parquet(spark, location), contract)
    parts = [_coerced(spark.read.parquet(*files), contract) for files in by_schema.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def resolve_tables(spark: SparkSession, data_dir: str, *, coerce: bool = True) -> dict[str, DataFrame]:
    """All raw tables found under a folder, by contract name; absent tables are left out."""
    tables = {}
    for contract in CONTRACTS.values():
        location = locate(spark, data_dir, contract)
        if location is not None:
            tables[contract.name] = read_contract(spark, location, contract) if coerce else read_parquet(spark, location)
    return tables


def source_catalog(spark: SparkSession, data_dir: str, *, date_ranges: bool = True) -> DataFrame:
    """One row per found table: location, files, rows, columns and its date spans."""
    rows = []
    for contract in CONTRACTS.values():
        location = locate(spark, data_dir, contract)
        if location is None:
            continue
        df = read_parquet(spark, location)
        files = parquet_files(spark, location)
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(contract.name).alias("table_name"),
            F.lit(location).alias("location"),
            F.lit(contract.canonical).alias("canonical_location"),
            F.lit(len(files)).alias("file_count"),
            "row_count",
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        )
        dates = [d for d in contract.dates if d in df.columns]
        if date_ranges and dates:
            spans = date_profile(df, dates).agg(F.collect_list(F.struct("*")).alias("date_ranges"))
            row = row.withColumn("one", F.lit(1)).join(spans.withColumn("one", F.lit(1)), "one").drop("one")
        rows.append(row)
    if not rows:
        raise FileNotFoundError(f"no raw table under {data_dir}")
    catalog = rows[0]
    for row in rows[1:]:
        catalog = catalog.unionByName(row, allowMissingColumns=True)
    return catalog


def read_dataset(spark: SparkSession, location: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV or parquet by suffix."""
    if location.endswith(".parquet"):
        return spark.read.schema(schema).parquet(location) if schema else spark.read.parquet(location)
    if location.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(location)
    raise ValueError(f"not a .csv or .parquet path: {location}")


def write_dataset(df: DataFrame, location: str, *, mode: str = "error") -> None:
    """CSV or parquet by suffix; folders are created."""
    if location.endswith(".parquet"):
        df.write.mode(mode).parquet(location)
    elif location.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(location)
    else:
        raise ValueError(f"not a .csv or .parquet path: {location}")


def prepared_panel(df: DataFrame) -> DataFrame:
    """A prepared panel with parsed dates and a checked key."""
    require_columns(df, PANEL_KEY, "prepared panel")
    panel = df.withColumn("formation_date", as_date(df, "formation_date"))
    require_unique(panel, PANEL_KEY, "prepared panel")
    return panel


def merge_prepared_features(
    frames: Sequence[DataFrame], *, check_keys: bool = True, clash_suffix: str | None = None
) -> DataFrame:
    """Left-join feature tables onto the first by (permno, formation_date).

    Tables without the key are ignored.  The first occurrence of a column wins, unless a
    ``clash_suffix`` is given, which keeps the later one under a new name.
    """
    keyed = [f for f in frames if set(PANEL_KEY) <= set(f.columns)]
    if not keyed:
        raise ValueError("no feature table carries (permno, formation_date)")
    if check_keys:
        for number, frame in enumerate(keyed):
            require_unique(frame, PANEL_KEY, f"prepared feature table {number}")
    merged = keyed[0]
    for frame in keyed[1:]:
        columns = [F.col(k) for k in PANEL_KEY]
        for name in frame.columns:
            if name in PANEL_KEY:
                continue
            if name not in merged.columns:
                columns.append(F.col(name))
            elif clash_suffix:
                columns.append(F.col(name).alias(name + clash_suffix))
        merged = merged.join(frame.select(*columns), list(PANEL_KEY), "left")
    return merged


def read_prepared_features(spark: SparkSession, folder: str) -> DataFrame:
    frames = [spark.read.parquet(f) for f in parquet_files(spark, folder)]
    return merge_prepared_features(frames)


def write_scores(scores: DataFrame, location: str, *, mode: str = "error") -> None:
    """Long scores, one folder per date, so that a reader of some dates or factors skips the rest."""
    scores.repartition("formation_date", F.pmod(F.xxhash64("permno"), F.lit(16))).sortWithinPartitions(
        "factor_id"
    ).write.mode(mode).partitionBy("formation_date").parquet(location)


def read_selected_scores(spark: SparkSession, location: str, factor_ids: Sequence[str]) -> DataFrame:
    """Scores of some factors; the filter reaches the parquet scan."""
    return spark.read.parquet(location).where(F.col("factor_id").isin(list(factor_ids)))


def write_run(
    spark: SparkSession, folder: str, tables: dict[str, DataFrame], manifest: dict[str, str], *,
    csv_tables: Sequence[str] = ("factor_model_metrics", "feature_importance"), mode: str = "error",
) -> None:
    """Result tables of one run and a one-row JSON manifest that names them."""
    for name, df in tables.items():
        write_dataset(df, f"{folder}/{name}.{'csv' if name in csv_tables else 'parquet'}", mode=mode)
    row = [F.lit(v).alias(k) for k, v in manifest.items()]
    row.append(F.array(*[F.lit(n) for n in tables]).alias("tables"))
    spark.range(1).select(*row).write.mode(mode).json(f"{folder}/manifest.json")


def write_links(folder: str, company: DataFrame, estimate: DataFrame, diagnostics: DataFrame, *, mode="error") -> None:
    company.write.mode(mode).parquet(f"{folder}/ccm_permno_links.parquet")
    estimate.write.mode(mode).parquet(f"{folder}/ibes_permno_links.parquet")
    diagnostics.write.mode(mode).json(f"{folder}/link_diagnostics.json")


def export_jobs(
    jobs: DataFrame, location: str, events: DataFrame | None = None, *, nested: bool = False, mode: str = "error"
) -> None:
    """Jobs as CSV; with events each event with the fields of its job, or ``nested`` each job with its events, as lines of JSON.

    A nested job is one row, so its history must fit one; otherwise events stay in rows of their own.
    """
    if events is None:
        jobs.write.mode(mode).option("header", True).csv(location)
        return
    if nested:
        # the number leads the structure, so that sorting the array sorts the history
        own = [c for c in events.columns if c not in ("job_id", "event_id")]
        histories = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("event_id", *own))).alias("events"))
        jobs.join(histories, "job_id", "left").withColumn("exported_at", F.current_timestamp()).write.mode(mode).json(location)
        return
    # One job's history may be long: it stays in rows, sorted, beside the job's own fields.
    jobs.join(events, "job_id", "left").sortWithinPartitions("job_id", "event_id").write.mode(mode).json(location)
