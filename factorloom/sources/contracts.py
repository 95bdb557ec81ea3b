"""Raw-table contracts and the checks that run against them.

The locations, column names, dates and keys are fixed values: tables written for the
published layout must resolve and validate unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_date

_TYPES = {
    "d": T.DateType(),
    "f": T.DoubleType(),
    "l": T.LongType(),
    "i": T.IntegerType(),
    "s": T.StringType(),
}


@dataclass(frozen=True)
class Contract:
    """Where a raw table lives and what it must hold."""

    name: str
    canonical: str
    locations: tuple[str, ...]
    schema: T.StructType
    dates: dict[str, bool]  # column -> may be missing
    key: tuple[str, ...]

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(self.schema.fieldNames())


def _contract(name: str, canonical: str, locations: str, columns: str, dates: str, key: str) -> Contract:
    fields = [T.StructField(n, _TYPES[t]) for n, t in (c.split(":") for c in columns.split())]
    nullable = {d.rstrip("?"): d.endswith("?") for d in dates.split()}
    return Contract(name, canonical, tuple(locations.split()), T.StructType(fields), nullable, tuple(key.split()))


# Locations in the order they are tried, columns, date columns (? = may be
# missing) and key of each raw table.
CONTRACTS: dict[str, Contract] = {
    c.name: c
    for c in (
        _contract(
            "crsp_monthly", "data/raw/crsp_monthly/",
            "monthly_crsp_msf_by_year monthly_crsp_msf.parquet crsp_msf.parquet",
            "permno:l permco:l date:d prc:f ret:f retx:f shrout:f vol:f cfacpr:f cfacshr:f market_cap:f",
            "date", "permno date",
        ),
        _contract(
            "crsp_names", "data/raw/crsp_names.parquet", "crsp_msenames.parquet crsp_names.parquet",
            "permno:l comnam:s ncusip:s ticker:s shrcd:i exchcd:i namedt:d nameenddt:d",
            "namedt nameenddt", "permno namedt nameenddt",
        ),
        _contract(
            "ccm_link", "data/raw/ccm_link.parquet", "ccm_linktable.parquet ccm_link.parquet",
            "gvkey:s linkprim:s liid:s linktype:s lpermno:l lpermco:l usedflag:i linkdt:d linkenddt:d",
            "linkdt linkenddt?", "gvkey liid lpermno linkdt linkenddt linktype linkprim",
        ),
        _contract(
            "comp_company", "data/raw/comp_company.parquet", "comp_company.parquet",
            "gvkey:s conm:s cik:s sic:s naics:s gsector:s gind:s gsubind:s fic:s loc:s ipodate:d",
            "ipodate?", "gvkey",
        ),
        _contract(
            "comp_fundq", "data/raw/comp_fundq/", "comp_fundq_by_year comp_fundq.parquet",
            "gvkey:s datadate:d rdq:d fyearq:i fqtr:i fyr:i indfmt:s datafmt:s popsrc:s consol:s curcdq:s "
            "oiadpq:f niq:f ceqq:f oancfy:f revtq:f atq:f ltq:f dlttq:f dlcq:f cogsq:f xsgaq:f dpq:f pstkq:f "
            "txditcq:f cshoq:f prccq:f epspxq:f epsfxq:f saleq:f",
            "datadate rdq?", "gvkey datadate fyearq fqtr indfmt datafmt popsrc consol",
        ),
        _contract(
            "ibes_link", "data/raw/ibes_link.parquet", "ibes_link.parquet",
            "ticker:s permno:l ncusip:s sdate:d edate:d score:f", "sdate edate", "ticker permno sdate edate",
        ),
        _contract(
            "ibes_summary", "data/raw/ibes_summary/", "ibes_statsum_epsus_by_year ibes_statsum_epsus.parquet",
            "ticker:s cusip:s oftic:s cname:s statpers:d fiscalp:s measure:s fpi:s numest:f meanest:f medest:f "
            "stdev:f highest:f lowest:f actual:f usfirm:i fpedats:d actdats_act:d anndats_act:d",
            "statpers fpedats actdats_act? anndats_act?", "ticker statpers measure fpi fpedats",
        ),
        _contract(
            "ibes_detail", "data/raw/ibes_detail/", "ibes_det_epsus_by_year ibes_det_epsus.parquet",
            "ticker:s cusip:s oftic:s cname:s analys:l estimator:l measure:s fpi:s value:f curr:s usfirm:i "
            "anndats:d revdats:d fpedats:d actual:f anndats_act:d",
            "anndats revdats fpedats anndats_act?",
            "ticker analys estimator measure fpi fpedats anndats revdats",
        ),
        _contract(
            "ibes_actual", "data/raw/ibes_actual/", "ibes_act_epsus_by_year ibes_act_epsus.parquet",
            "ticker:s cusip:s oftic:s cname:s anndats:d measure:s pends:d value:f curr_act:s usfirm:i actdats:d",
            "anndats pends actdats", "ticker measure pends anndats actdats",
        ),
        _contract(
            "ibes_target", "data/raw/ibes_target/", "ibes_ptgsum_by_year ibes_ptgsum.parquet",
            "ticker:s cusip:s oftic:s cname:s statpers:d numest:f numup4w:f numdown4w:f numup1m:f numdown1m:f "
            "meanptg:f medptg:f stdev:f ptghigh:f ptglow:f curr:s usfirm:i measure:s",
            "statpers", "ticker statpers measure",
        ),
        _contract(
            "macro_features", "data/raw/macro_features.parquet", "macro_features.parquet",
            "date:d sp500:f nasdaq:f treasury_2y:f treasury_10y:f", "date", "date",
        ),
    )
}


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    present = set(df.columns)
    return [name for name in required if name not in present]


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> None:
    missing = sorted(missing_columns(df, required))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def date_profile(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    """One row per date column: span, filled rows and rows that do not parse; one scan."""
    sums = []
    for name in dates:
        parsed = as_date(df, name)
        sums += [
            F.min(parsed).alias(f"{name}:min"),
            F.max(parsed).alias(f"{name}:max"),
            F.count(name).alias(f"{name}:filled"),
            F.count_if(F.col(name).isNotNull() & parsed.isNull()).alias(f"{name}:bad"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("date_column"),
            F.col(f"`{name}:min`").alias("min_date"),
            F.col(f"`{name}:max`").alias("max_date"),
            F.col(f"`{name}:filled`").alias("non_null_count"),
            F.col(f"`{name}:bad`").alias("parse_failures"),
        )
        for name in dates
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows))).withColumn("ok", F.col("parse_failures") == 0)


def duplicate_key_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, NULLs equal.  Copies collapse before the shuffle."""
    copies = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_checked"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
    ).withColumn("severity", F.when(F.col("duplicate_count") > 0, "warning").otherwise("ok"))


def require_unique(df: DataFrame, key: Sequence[str], what: str) -> None:
    require_columns(df, key, what)
    duplicates = duplicate_key_count(df, key).first()["duplicate_count"]
    if duplicates:
        raise ValueError(f"{what}: {duplicates} rows repeat the key {tuple(key)}")


def table_summary(df: DataFrame, date_column: str | None = None) -> DataFrame:
    """One row per column with its missing values, and the row and date figures of the table."""
    names = df.columns
    sums = [F.count(F.lit(1)).alias("rows")]
    sums += [F.count_if(F.col(n).isNull()).alias(f"missing:{n}") for n in names]
    parsed = as_date(df, date_column) if date_column else F.lit(None).cast("date")
    sums += [
        F.count_if(parsed.isNull()).alias("invalid"),
        F.min(parsed).alias("first"),
        F.max(parsed).alias("last"),
    ]
    rows = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.col(f"`missing:{n}`").alias("missing_values"),
            F.col("rows").alias("row_count"),
            F.lit(len(names)).alias("column_count"),
            F.col("invalid").alias("invalid_dates"),
            F.col("first").alias("start_date"),
            F.col("last").alias("end_date"),
        )
        for n in names
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def contract_figures(df: DataFrame, contract: Contract) -> DataFrame:
    """One row with all figures of a contract: rows, repeated keys and each date's span and failures.

    The table is scanned once and shuffled once.  Rows of a key fold to their number and the span
    and counts of their dates, all of which can be added up again over the keys; NULLs are equal
    in a key.  Without a complete key ``duplicate_count`` is NULL and nothing is shuffled.  A date
    column that is missing has no entry in ``dates``.
    """
    dates = [d for d in contract.dates if d in df.columns]
    first = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(dates):
        parsed = as_date(df, name)
        first += [
            F.min(parsed).alias(f"_min{i}"), F.max(parsed).alias(f"_max{i}"), F.count(name).alias(f"_filled{i}"),
            F.count_if(F.col(name).isNotNull() & parsed.isNull()).alias(f"_bad{i}"),
        ]
    keyed = not missing_columns(df, contract.required)
    folded = df.groupBy(*contract.key).agg(*first) if keyed else df.agg(*first)
    zero = F.lit(0).cast("long")
    again = [F.coalesce(F.sum("_rows"), zero).alias("row_count"), F.count(F.lit(1)).alias("_keys")]
    for i in range(len(dates)):
        again += [F.min(f"_min{i}").alias(f"_min{i}"), F.max(f"_max{i}").alias(f"_max{i}")]
        again += [F.coalesce(F.sum(f"_{n}{i}"), zero).alias(f"_{n}{i}") for n in ("filled", "bad")]
    spans = [
        F.struct(
            F.lit(name).alias("date_column"), F.col(f"_min{i}").alias("min_date"), F.col(f"_max{i}").alias("max_date"),
            F.col(f"_filled{i}").alias("non_null_count"), F.col(f"_bad{i}").alias("parse_failures"),
        )
        for i, name in enumerate(dates)
    ]
    failures = zero
    for i in range(len(dates)):
        failures = failures + F.col(f"_bad{i}")
    empty = F.from_json(F.lit("[]"), "array<struct<date_column string, min_date date, max_date date, non_null_count long, "
                        "parse_failures long>>")
    return folded.agg(*again).select(
        "row_count", (F.col("row_count") - F.col("_keys") if keyed else F.lit(None).cast("long")).alias("duplicate_count"),
        failures.alias("parse_failures"), (F.array(*spans) if spans else empty).alias("dates"),
    )


def contract_report(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per contract: present, columns, dates, duplicates, overall ok; one scan a table.

    Duplicates only warn.  The overall answer is that every row is ok.
    """
    rows = []
    for contract in CONTRACTS.values():
        df = tables.get(contract.name)
        missing = missing_columns(df, contract.required) if df is not None else []
        stated = [F.lit(contract.name).alias("table_name"), F.lit(df is not None).alias("found"),
                  F.lit(",".join(missing)).alias("missing_columns")]
        if df is None:
            rows.append(spark.range(1).select(*stated).selectExpr(
                "*", "0L AS parse_failures", "CAST(NULL AS BIGINT) AS duplicate_count", "false AS ok"))
            continue
        complete = not missing and all(d in df.columns for d in contract.dates)
        rows.append(contract_figures(df, contract).select(
            *stated, "parse_failures", "duplicate_count", (F.lit(complete) & (F.col("parse_failures") == 0)).alias("ok")
        ))
    return reduce(DataFrame.unionByName, rows)


def table_date_spans(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, date column, span, filled, failures) of every table with a contract; one scan a table."""
    known = [c for c in CONTRACTS.values() if c.name in tables]
    rows = [
        contract_figures(tables[c.name], c).select(F.lit(c.name).alias("table_name"), "row_count", F.inline("dates"))
        for c in known
    ]
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame(
        [], "table_name string, row_count long, date_column string, min_date date, max_date date, non_null_count long, parse_failures long"
    )
