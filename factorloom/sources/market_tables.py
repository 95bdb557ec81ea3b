"""The research tables, derived from the driver's order and shipment tables.

Every table comes from one aggregation over its source with map-side combining, so that a supplier
or customer that owns a large share of the rows costs no more than the others; those of the lines share one.  Each result
has one row per key and calendar month, quarter or day, which bounds every later window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import shared_stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_count(spark: SparkSession, sf_dir: str) -> int:
    """Answered from the parquet footers."""
    return table(spark, sf_dir, "supplier").count()


def _six_digits(key):
    return F.lpad(key.cast("string"), 6, "0")


def _day(text: str):
    return F.lit(text).cast("date")


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sum of the lines by supplier and month: the lines are read and shuffled once for all tables made of it."""
    # Whole cents add up exactly in any order, so equal estimates stay equal.
    discount, tax = (F.round(F.col(c) * 100).cast("long") for c in ("l_discount", "l_tax"))

    def build():
        return (
            table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_suppkey").alias("k"), F.last_day(F.to_date("l_shipdate")).alias("date"))
            .agg(
                F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("prc"), F.sum("l_quantity").alias("shrout"),
                F.count(F.lit(1)).alias("n"), F.sum(discount).alias("d"), F.sum(discount * discount).alias("dd"),
                F.sum(tax).alias("t"), F.avg("l_extendedprice").alias("meanptg"),
                F.count_if(F.col("l_returnflag") == "A").cast("double").alias("numup1m"),
                F.count_if(F.col("l_returnflag") == "R").cast("double").alias("numdown1m"),
            )
        )

    return shared_stage(spark, "supplier_month", sf_dir, build)


def security_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = supplier_month(spark, sf_dir).select(
        F.col("k").alias("permno"), "date", "prc", "shrout", F.col("n").cast("double").alias("vol")
    )
    ret = F.col("prc") / F.lag("prc").over(Window.partitionBy("permno").orderBy("date")) - 1
    return months.select(
        "permno", F.col("permno").alias("permco"), "date", "prc", ret.alias("ret"), ret.alias("retx"),
        "shrout", "vol", (1 + F.col("permno") % 2).cast("double").alias("cfacpr"),
        F.lit(1.0).alias("cfacshr"), (F.col("prc") * F.col("shrout")).alias("market_cap"),
    )


def _two_periods(first_end: str, second_start) -> list:
    return [
        F.struct(F.lit(0).alias("n"), _day("1995-01-01").alias("start"), _day(first_end).alias("end")),
        F.struct(F.lit(1).alias("n"), second_start.alias("start"), F.lit(None).cast("date").alias("end")),
    ]


def name_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").withColumn(
        "p", F.explode(F.array(*_two_periods("1998-06-30", _day("1998-07-01"))))
    )
    return names.select(
        F.col("s_suppkey").alias("permno"), F.col("s_name").alias("comnam"),
        _six_digits(F.col("s_suppkey")).alias("ncusip"),
        F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"),
        (10 + F.col("s_suppkey") % 3).cast("int").alias("shrcd"),
        (1 + (F.col("s_nationkey") + F.col("p.n")) % 4).cast("int").alias("exchcd"),
        F.col("p.start").alias("namedt"), F.col("p.end").alias("nameenddt"),
    )


def company_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("s_suppkey") % 7 == 0, _day("1998-01-01")).otherwise(_day("1998-07-01"))
    links = table(spark, sf_dir, "supplier").withColumn(
        "p", F.explode(F.array(*_two_periods("1998-06-30", second)))
    )
    first = F.col("p.n") == 0
    return links.select(
        _six_digits(F.col("s_suppkey")).alias("gvkey"),
        F.when(first, "P").otherwise("C").alias("linkprim"), F.lit("01").alias("liid"),
        F.when(first, "LC").otherwise("LU").alias("linktype"),
        F.col("s_suppkey").alias("lpermno"), F.col("s_suppkey").alias("lpermco"), F.lit(1).alias("usedflag"),
        F.col("p.start").alias("linkdt"), F.col("p.end").alias("linkenddt"),
    )


def fundamentals_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = supplier_count(spark, sf_dir)
    day = F.to_date("o_orderdate")
    quarter_end = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    price = F.col("o_totalprice")
    sums = (
        table(spark, sf_dir, "orders")
        .groupBy((F.col("o_custkey") % suppliers).alias("k"), quarter_end.alias("datadate"))
        .agg(
            F.sum(price).alias("revtq"), F.max(price).alias("ceqq"), F.min(price).alias("dlttq"),
            F.count(F.lit(1)).cast("double").alias("cshoq"), F.avg(price).alias("mean_price"),
        )
    )
    niq = F.col("revtq") / 1000
    return sums.select(
        _six_digits(F.col("k")).alias("gvkey"), "datadate",
        F.when(F.col("k") % 5 != 0, F.date_add("datadate", (20 + F.col("k") % 60).cast("int"))).alias("rdq"),
        niq.alias("oiadpq"), niq.alias("niq"), "ceqq", "revtq",
        (F.col("ceqq") * 3).alias("atq"), (F.col("ceqq") * 2).alias("ltq"), "dlttq",
        F.when(F.col("k") % 3 != 0, F.col("dlttq") / 2).alias("dlcq"), "cshoq",
        (F.col("mean_price") / 100).alias("prccq"), (niq / F.col("cshoq")).alias("epspxq"),
        F.col("revtq").alias("saleq"),
    )


def ticker_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    letter = F.when(key % 2 == 1, "t").otherwise("T")
    return table(spark, sf_dir, "supplier").select(
        F.concat(letter, key.cast("string")).alias("ticker"), key.alias("permno"),
        _six_digits(key).alias("ncusip"), _day("1995-01-01").alias("sdate"),
        F.lit(None).cast("date").alias("edate"), (key % 3).cast("double").alias("score"),
    )


def _estimate_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid_month = F.date_add(F.trunc("date", "month"), 14)
    return supplier_month(spark, sf_dir).withColumn("statpers", mid_month)


def estimate_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _estimate_months(spark, sf_dir)
    n, d = F.col("n"), F.col("d")
    spread = F.sqrt((n * F.col("dd") - d * d) / F.nullif(n * (n - 1), F.lit(0)))
    return sums.select(
        F.concat(F.lit("T"), F.col("k").cast("string")).alias("ticker"), "statpers", F.lit("EPS").alias("measure"),
        (d / n).alias("meanest"), spread.alias("stdev"), n.cast("double").alias("numest"),
        (F.col("t") / n).alias("actual"),
        F.date_add("statpers", (10 * (F.col("k") % 3 - 1)).cast("int")).alias("actdats_act"),
        F.lit(None).cast("date").alias("anndats_act"),
    )


def target_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimate_months(spark, sf_dir).select(
        F.concat(F.lit("T"), F.col("k").cast("string")).alias("ticker"), "statpers",
        "meanptg", "numup1m", "numdown1m", F.col("n").cast("double").alias("numest"),
    )


# The five order priorities and the macro series that each one feeds.
PRIORITIES = {
    "urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW",
}


def macro_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(*[
            F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias(name)
            for name, p in PRIORITIES.items()
        ])
    )


# Macro series of the wide table and the narrow one each of them takes its values from.
WIDE_SERIES = {
    "sp500": "urgent", "nasdaq": "high", "treasury_10y": "medium", "vix": "unspecified", "consumer_sentiment": "low",
}
# Rows that each change looks back.
CHANGES = {"_c20": 20, "_c60": 60, "_m1": 21, "_m3": 63, "_yoy": 252}


def macro_daily_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series with their changes over some rows; one row a day goes into the window."""
    daily = macro_daily(spark, sf_dir)
    by_day = Window.partitionBy().orderBy("date")
    columns = [F.col("date")]
    for name, source in WIDE_SERIES.items():
        columns.append(F.col(source).alias(name))
        columns += [(F.col(source) - F.lag(source, n).over(by_day)).alias(f"{name}{suffix}") for suffix, n in CHANGES.items()]
    return daily.select(*columns)


def predictions(monthly: DataFrame) -> DataFrame:
    """Next month's return and its reversal forecast, by security and month."""
    following = F.lead("ret").over(Window.partitionBy("permno").orderBy("date"))
    return monthly.select(
        F.col("permno").alias("id"), F.col("date").alias("period"),
        following.alias("actual"), (-F.col("ret")).alias("prediction"),
    )


# The job state that each kind of event stands for.
EVENT_STATES = {
    "signup": "QUEUED", "view": "CLAIMED", "click": "RUNNING", "purchase": "SUCCEEDED", "error": "FAILED",
}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a row; every fourth number among the errors ends in the dead-letter queue."""
    state = F.create_map(*[F.lit(x) for pair in EVENT_STATES.items() for x in pair])
    dead = (F.col("event_type") == "error") & (F.col("event_id") % 4 == 3)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), "event_id", "event_type",
        F.when(dead, "DEAD_LETTER").otherwise(F.try_element_at(state, F.col("event_type"))).alias("to_state"),
        F.col("ts").alias("occurred_at"),
    )
