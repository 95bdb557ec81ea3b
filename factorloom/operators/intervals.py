"""Point-in-time joins and identifier links.

All joins are equality joins on the identifier with the date range as a residual condition,
so a shuffled join can split a hot identifier.  Where one match per key is wanted it is
taken by an aggregate that combines before the shuffle, never by sorting all matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import active_on, as_date, as_long, as_number, closed_end, normalized_text

# Share codes of common stock and the major exchanges.
COMMON_SHARE_CODES = (10, 11)
MAJOR_EXCHANGES = (1, 2, 3)


def common_stock(names: DataFrame) -> DataFrame:
    return names.where(F.col("shrcd").isin(*COMMON_SHARE_CODES) & F.col("exchcd").isin(*MAJOR_EXCHANGES))


def clean_names(names: DataFrame, *, common_stock_only: bool = True) -> DataFrame:
    typed = names.withColumns(
        {
            "permno": as_long("permno"), "shrcd": as_long("shrcd"), "exchcd": as_long("exchcd"),
            "namedt": as_date(names, "namedt"), "nameenddt": as_date(names, "nameenddt"),
        }
    ).where(F.col("permno").isNotNull() & F.col("namedt").isNotNull())
    return common_stock(typed) if common_stock_only else typed


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str], *, last=False) -> DataFrame:
    """One row per key: the first (or last) in ``order``; further ties go by the kept values.

    NULL sorts first, as in a struct comparison.
    """
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in keep])
    best = (F.max if last else F.min)(ranked).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in keep])


def join_active(
    rows: DataFrame, intervals: DataFrame, on: str, day: str, start: str, end: str
) -> DataFrame:
    """Rows with every different interval of the same identifier that contains the day.

    Copies of an interval collapse first: every caller keeps one match per key, so copies
    would only multiply the rows of a repeated identifier.
    """
    right = intervals.withColumnRenamed(on, "_on").distinct()
    inside = active_on(rows[day], right[start], right[end])
    return rows.join(right, (rows[on] == right["_on"]) & inside).drop("_on")


def overlap_join(
    links: DataFrame, names: DataFrame, *, permno: str, start: str, end: str, carry: Sequence[str]
) -> DataFrame:
    """Links cut to the name periods they overlap; an end stays open only if both are open."""
    n = names.select(F.col("permno").alias("n_permno"), *carry)
    ready = links.withColumns({permno: as_long(permno), start: as_date(links, start), end: as_date(links, end)})
    ready = ready.where(F.col(permno).isNotNull() & F.col(start).isNotNull())
    joined = ready.join(
        n,
        (F.col(permno) == F.col("n_permno"))
        & (F.col(start) <= closed_end("nameenddt"))
        & (F.col("namedt") <= closed_end(end)),
    )
    both_open = F.col(end).isNull() & F.col("nameenddt").isNull()
    return joined.withColumns(
        {
            "valid_start": F.greatest(start, "namedt"),
            "valid_end": F.when(~both_open, F.least(closed_end(end), closed_end("nameenddt"))),
        }
    ).drop("n_permno")


def company_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Company links restricted to the time their security was a listed common stock."""
    joined = overlap_join(
        links, clean_names(names), permno="lpermno", start="linkdt", end="linkenddt",
        carry=["comnam", "ncusip", "ticker", "shrcd", "exchcd", "namedt", "nameenddt"],
    )
    return joined.select(
        "gvkey", F.col("lpermno").alias("permno"), "lpermco", "linkprim", "liid", "linktype", "usedflag",
        "linkdt", "linkenddt", "valid_start", "valid_end", "comnam", "ncusip", "ticker", "shrcd", "exchcd",
        "namedt", "nameenddt",
    )


def eligible_estimate_links(links: DataFrame, max_score: float = 1) -> DataFrame:
    """Links with a known score of at most ``max_score``."""
    return links.withColumn("score", as_number("score")).where(F.col("score") <= max_score)


def estimate_links(links: DataFrame, names: DataFrame, *, max_score: float = 1) -> DataFrame:
    """Ticker links of acceptable score, cut to the listed common-stock periods."""
    ready = eligible_estimate_links(links, max_score).select(
        F.col("ticker").alias("ibes_ticker"), "permno", F.col("ncusip").alias("ibes_ncusip"), "score", "sdate", "edate"
    )
    renamed = clean_names(names).withColumnRenamed("ticker", "crsp_ticker")
    joined = overlap_join(
        ready, renamed, permno="permno", start="sdate", end="edate",
        carry=["comnam", "crsp_ticker", "shrcd", "exchcd", "namedt", "nameenddt"],
    )
    return joined.select(
        "ibes_ticker", "permno", "ibes_ncusip", "score", "sdate", "edate", "valid_start", "valid_end",
        "comnam", "crsp_ticker", "shrcd", "exchcd", "namedt", "nameenddt",
    )


def overlap_count(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows that start on or before the latest end seen earlier in their group.

    Rows of one group and start day collapse to three numbers first, so a group's window
    holds at most one row per calendar day.  Among rows that start together, ordered by
    end, every valid one after the first valid one overlaps.
    """
    day = as_date(df, start)
    per_day = (
        df.withColumns({"_s": day, "_e": closed_end(as_date(df, end))}).where(F.col("_s").isNotNull())
        .groupBy(*keys, "_s")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("_e") >= F.col("_s")).alias("valid"),
            F.max("_e").alias("latest"),
        )
    )
    earlier = F.max("latest").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    hit = F.when(earlier >= F.col("_s"), F.col("rows")).otherwise(F.greatest(F.col("valid") - 1, F.lit(0)))
    return per_day.select(hit.alias("hit")).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("overlap_count"))


def unmatched_rate(total: Column, matched: Column) -> list[Column]:
    unmatched = F.greatest(total - matched, F.lit(0))
    return [
        total.alias("total_count"), matched.alias("matched_count"), unmatched.alias("unmatched_count"),
        F.coalesce(F.try_divide(unmatched.cast("double"), total.cast("double")), F.lit(0.0)).alias("unmatched_rate"),
    ]


def unmatched_rows(source: DataFrame, resolved: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows behind the unmatched rate."""
    return source.join(resolved.select(*on), list(on), "left_anti")


def link_diagnostics(
    source: DataFrame, resolved: DataFrame, *, source_id: str, row_key: Sequence[str],
    keys: Sequence[str], start: str, end: str,
) -> DataFrame:
    """One row: matched and unmatched source rows, overlaps and resolved rows.

    ``row_key`` names the columns that identify a source row on both sides.
    """
    linkable = source.where(F.col(source_id).isNotNull())
    total = linkable.agg(F.count(F.lit(1)).alias("total"))
    matched = resolved.groupBy(*row_key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("resolved_row_count")
    )
    overlaps = overlap_count(linkable, keys, start, end)
    one_row = [d.withColumn("one", F.lit(1)) for d in (total, matched, overlaps)]
    joined = reduce(lambda a, b: a.join(b, "one"), one_row)
    return joined.select(
        *unmatched_rate(F.col("total"), F.col("matched")), "overlap_count",
        F.col("overlap_count").alias("duplicate_active_link_count"), "resolved_row_count",
    )


def estimate_link_diagnostics(links: DataFrame, names: DataFrame, *, max_score: float = 1) -> DataFrame:
    """Diagnostics of the ticker links, with the number of links whose score is missing or too high."""
    numbered = links.withColumn("sdate", as_date(links, "sdate"))
    eligible = eligible_estimate_links(numbered, max_score)
    resolved = estimate_links(numbered, names, max_score=max_score)
    figures = link_diagnostics(
        eligible.withColumnRenamed("ticker", "ibes_ticker"), resolved, source_id="permno",
        row_key=["ibes_ticker", "permno", "sdate", "edate"], keys=["ibes_ticker"], start="sdate", end="edate",
    )
    kept = as_number("score") <= max_score
    dropped = links.agg(F.count_if(~F.coalesce(kept, F.lit(False))).alias("score_filtered_out_count"))
    return figures.withColumn("one", F.lit(1)).join(dropped.withColumn("one", F.lit(1)), "one").drop("one")


# --- identifiers at a date -------------------------------------------------------------


def resolve_names(requests: DataFrame, names: DataFrame, *, common_stock_only: bool = True) -> DataFrame:
    """(permno, date) requests -> the name row active then; the earliest one wins."""
    active = join_active(requests, clean_names(names, common_stock_only=common_stock_only),
                         "permno", "date", "namedt", "nameenddt")
    return first_match(active, ["permno", "date"], [F.col("namedt"), closed_end("nameenddt")],
                       ["shrcd", "exchcd", "namedt", "nameenddt"])


def resolve_company(requests: DataFrame, links: DataFrame) -> DataFrame:
    """(gvkey, date) requests -> security; earliest link, then primary rank, then used flag."""
    ready = links.withColumns({"gvkey": F.col("gvkey").cast("string"), "lpermno": as_long("lpermno"),
                               "linkdt": as_date(links, "linkdt"), "linkenddt": as_date(links, "linkenddt")})
    rank = F.lit(2)
    if "linkprim" in links.columns:
        rank = F.when(F.col("linkprim") == "P", 0).when(F.col("linkprim") == "C", 1).otherwise(2)
    used = F.lit(0.0)
    if "usedflag" in links.columns:
        used = -F.coalesce(as_number("usedflag"), F.lit(-999.0))
    ready = ready.where(F.col("lpermno").isNotNull()).select(
        "gvkey", F.col("lpermno").alias("permno"), "linkdt", "linkenddt", rank.alias("_rank"), used.alias("_used")
    )
    active = join_active(requests, ready, "gvkey", "date", "linkdt", "linkenddt")
    order = [F.col("linkdt"), closed_end("linkenddt"), F.col("_rank"), F.col("_used")]
    return first_match(active, ["gvkey", "date"], order, ["permno"])


def resolve_ticker(requests: DataFrame, links: DataFrame, *, max_score: float = 1) -> DataFrame:
    """(ticker, date) requests -> security; earliest link, then best score."""
    ready = links.withColumns({"ticker": normalized_text("ticker"), "permno": as_long("permno"),
                               "sdate": as_date(links, "sdate"), "edate": as_date(links, "edate")})
    score = F.lit(0.0)
    if "score" in links.columns:
        ready = eligible_estimate_links(ready, max_score)
        score = F.col("score")
    ready = ready.where(F.col("permno").isNotNull()).select("ticker", "permno", "sdate", "edate", score.alias("_score"))
    active = join_active(requests.withColumn("ticker", normalized_text("ticker")), ready, "ticker", "date", "sdate", "edate")
    order = [F.col("sdate"), closed_end("edate"), F.col("_score")]
    return first_match(active, ["ticker", "date"], order, ["permno"])


def resolve_identifiers(
    requests: DataFrame, names: DataFrame, company: DataFrame, estimate: DataFrame, *, max_score: float = 1
) -> DataFrame:
    """(kind, identifier, date) requests -> security, NULL unless it is also listed then.

    ``kind`` is permno, gvkey or ibes_ticker; any other kind resolves to nothing.
    """
    asked = requests.select("kind", "identifier", "date").distinct()

    def of(kind: str, column: str) -> DataFrame:
        return asked.where(F.col("kind") == kind).select(F.col("identifier").alias(column), "date")

    found = [
        of("permno", "identifier").withColumn("permno", as_long("identifier")).withColumn("kind", F.lit("permno")),
        resolve_company(of("gvkey", "gvkey"), company).withColumnRenamed("gvkey", "identifier")
        .withColumn("kind", F.lit("gvkey")),
    ]
    ticker_requests = of("ibes_ticker", "raw").withColumn("ticker", normalized_text("raw"))
    tickers = resolve_ticker(ticker_requests.select("ticker", "date").distinct(), estimate, max_score=max_score)
    found.append(
        ticker_requests.join(tickers, ["ticker", "date"]).select(F.col("raw").alias("identifier"), "date", "permno")
        .withColumn("kind", F.lit("ibes_ticker"))
    )
    columns = ["kind", "identifier", "date", "permno"]
    candidates = reduce(DataFrame.unionByName, [f.select(*columns) for f in found])
    listed = resolve_names(candidates.select("permno", "date").distinct(), names).select("permno", "date")
    good = candidates.join(listed, ["permno", "date"], "left_semi")
    return asked.join(good, ["kind", "identifier", "date"], "left")


# --- as-of -----------------------------------------------------------------------------

def asof_backward(
    left: DataFrame, rights: Sequence[tuple[DataFrame, Sequence[str]]], *, key: str, left_date: str,
    right_date: str = "available_date",
) -> DataFrame:
    """Latest row of each right table whose date is on or before the left date.

    All sides are stacked and read in one pass per key: one shuffle for any number of right
    tables.  The right tables must have one row per key and date, so a key's window holds at
    most one row per calendar day and table.  Columns of a right row travel together: a
    missing value of the latest row stays missing.
    """
    taken = left.columns
    stacked = left.withColumns({"_day": F.col(left_date), "_side": F.lit(1)})
    for number, (right, columns) in enumerate(rights):
        one = right.select(
            F.col(key), F.col(right_date).alias("_day"), F.lit(0).alias("_side"),
            F.struct(*columns).alias(f"_right{number}"),
        ).where(F.col(key).isNotNull() & F.col("_day").isNotNull())
        stacked = stacked.unionByName(one, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = {f"_right{n}": F.last(f"_right{n}", ignorenulls=True).over(order) for n in range(len(rights))}
    matched = stacked.withColumns(latest).where(F.col("_side") == 1)
    out = [F.col(c) for c in taken]
    for number, (_, columns) in enumerate(rights):
        out += [F.col(f"_right{number}.{c}").alias(c) for c in columns]
    return matched.select(*out)


