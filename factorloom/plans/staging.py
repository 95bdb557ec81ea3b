"""Stage boundaries: a written table in the cluster's shared checkpoint folder.

A staged table cuts the lineage, outlives lost executors, keeps column pruning and filter
pushdown for the next stage, and has a known file size.  That size is what the optimizer
checks before it broadcasts: small tables are broadcast, larger ones fall back to a
shuffled join with adaptive skew handling.  The code therefore carries no broadcast hint
for anything that grows with the data.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_local_roots: dict[str, str] = {}
_shared: dict[tuple[str, str, str], DataFrame] = {}


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables; a machine-local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    application = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/factorloom/{application}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_roots[application]


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def shared_stage(spark: SparkSession, label: str, scope: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stage a table that several queries of one application start from."""
    key = (spark.sparkContext.applicationId, label, scope)
    if key not in _shared:
        _shared[key] = stage(build(), label)
    return _shared[key]


def forget_shared_stages() -> None:
    """Make the next query build its inputs again (used for timing)."""
    _shared.clear()


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of given rows as a local relation, whose size the optimizer knows."""
    struct = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in struct.fields]
    arrow = to_arrow_schema(struct)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(table, schema=struct)
