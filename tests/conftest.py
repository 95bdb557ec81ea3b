import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("factorloom-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Table from rows of text: dates as text are cast by the schema."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def build(schema: str, *rows):
        wanted = T.StructType.fromDDL(schema)
        loose = T.StructType([
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.DateType, T.TimestampNTZType)) else f.dataType)
            for f in wanted.fields
        ])
        raw = spark.createDataFrame([tuple(r) for r in rows], loose)
        return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])

    return build


def rows_of(df, *columns, order=None):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple(str(x) for x in r)) if order is None else [
        tuple(r) for r in picked.orderBy(*order).collect()
    ]
