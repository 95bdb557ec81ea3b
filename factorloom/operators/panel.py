"""Monthly security panel, forward-return labels and row caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_date, as_long, as_number, closed_end
from ..plans.orderstats import pick_ranked
from ..plans.staging import stage
from ..sources.contracts import require_columns, require_unique
from .intervals import clean_names, first_match, join_active

HORIZONS = (1, 3, 6)
UNIVERSE_COLUMNS = (
    "permno", "permco", "formation_date", "price", "adjusted_price", "ret_1m", "retx_1m", "shrout", "vol",
    "market_cap", "shrcd", "exchcd",
)
_NUMBERS = ("prc", "ret", "retx", "shrout", "vol", "cfacpr", "cfacshr")


def clean_monthly(monthly: DataFrame) -> DataFrame:
    require_columns(monthly, ("permno", "permco", "date", *_NUMBERS), "monthly security table")
    typed = {c: as_number(c) for c in _NUMBERS}
    typed |= {"permno": as_long("permno"), "permco": as_long("permco"), "date": as_date(monthly, "date")}
    return monthly.withColumns(typed).where(F.col("permno").isNotNull() & F.col("date").isNotNull())


def between_dates(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def label_columns(horizons: Sequence[int] = HORIZONS) -> list[str]:
    names = ["forward_return_start", "forward_return_end"]
    for h in sorted(set(horizons)):
        names.append(f"ret_{h}m_fwd")
        if h != 1:
            names.append(f"forward_return_end_{h}m")
    return names


def with_forward_returns(
    monthly: DataFrame, horizons: Sequence[int] = HORIZONS, *, require_contiguous_months: bool = False
) -> DataFrame:
    """Add the compounded return of the next h rows of each security.

    A label needs all h following rows with a return.  Rows count, not calendar months, as
    long as ``require_contiguous_months`` is off.  One window sort serves all horizons; a
    security has at most one row per month, which bounds the window.
    """
    if not horizons:
        raise ValueError("at least one horizon is needed")
    if 1 not in horizons:
        raise ValueError("the one-month horizon is needed")
    by_security = Window.partitionBy("permno").orderBy("date")
    added = {
        "forward_return_start": F.lead("date", 1).over(by_security),
        "forward_return_end": F.lead("date", 1).over(by_security),
    }
    for h in sorted(set(horizons)):
        ahead = by_security.rowsBetween(1, h)
        end = F.lead("date", h).over(by_security)
        complete = F.count("ret").over(ahead) == h
        if require_contiguous_months:
            complete = complete & (F.last_day(end) == F.last_day(F.add_months("date", h)))
        added[f"ret_{h}m_fwd"] = F.when(complete, F.product(F.col("ret") + 1).over(ahead) - 1)
        if h != 1:
            added[f"forward_return_end_{h}m"] = F.when(complete, end)
    return monthly.withColumns(added)


def forward_returns(
    monthly: DataFrame, horizons: Sequence[int] = HORIZONS, *, check_key: bool = True, **options
) -> DataFrame:
    """Labels alone, by (permno, formation_date), over all monthly rows.

    The key check refuses repeated rows, which would spoil the labels and unbound the window."""
    rows = clean_monthly(monthly).select("permno", "date", "ret")
    if check_key:
        require_unique(rows, ("permno", "date"), "monthly security table")
    labels = with_forward_returns(rows, horizons, **options)
    return labels.select("permno", F.col("date").alias("formation_date"), *label_columns(horizons))


def monthly_universe(
    monthly: DataFrame, names: DataFrame, *, start: str | None = None, end: str | None = None,
    min_market_cap: float | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """Monthly rows whose security was a listed common stock on that day.

    If several name periods contain the day, the one that started last wins.
    """
    rows = between_dates(monthly if carry else clean_monthly(monthly), "date", start, end)
    periods = clean_names(names).select("permno", "shrcd", "exchcd", "namedt", "nameenddt")
    active = join_active(rows, periods, "permno", "date", "namedt", "nameenddt")
    kept = ["permco", "prc", "ret", "retx", "shrout", "vol", "cfacpr", "shrcd", "exchcd", *carry]
    one = first_match(active, ["permno", "date"], [F.col("namedt"), closed_end("nameenddt")], kept, last=True)
    price = F.abs("prc")
    universe = one.select(
        "permno", "permco", F.col("date").alias("formation_date"), price.alias("price"),
        F.when(F.col("cfacpr") != 0, price / F.nullif(F.col("cfacpr"), F.lit(0.0))).alias("adjusted_price"),
        F.col("ret").alias("ret_1m"), F.col("retx").alias("retx_1m"), "shrout", "vol",
        (price * F.col("shrout") * 1000.0).alias("market_cap"), "shrcd", "exchcd", *carry,
    )
    if min_market_cap is not None:
        universe = universe.where(F.col("market_cap") >= min_market_cap)
    return universe


def monthly_panel(
    monthly: DataFrame, names: DataFrame, *, start: str | None = None, end: str | None = None,
    horizons: Sequence[int] = HORIZONS, min_market_cap: float | None = None, check_key: bool = True,
) -> DataFrame:
    """Universe rows with their labels and source tags.

    Labels are added to the monthly rows before the universe is cut out of them, so both
    share one shuffle by security and no join of the labels is needed.
    """
    rows = clean_monthly(monthly)
    if check_key:
        require_unique(rows, ("permno", "date"), "monthly security table")
    labelled = with_forward_returns(rows, horizons)
    universe = monthly_universe(labelled, names, start=start, end=end, min_market_cap=min_market_cap,
                                carry=label_columns(horizons))
    return universe.withColumns(
        {"universe_source": F.lit("monthly_active_names"), "label_source": F.lit("monthly_returns")}
    )


def default_feature_columns(panel: DataFrame) -> list[str]:
    """Every column but the keys, the label windows, the labels and the source tags."""
    fixed = {"permno", "formation_date", "label_source", "universe_source", *label_columns()}
    return [c for c in panel.columns if c not in fixed and not c.endswith("_fwd")]


def check_labels(panel: DataFrame, *, feature_columns: Sequence[str] | None = None) -> DataFrame:
    """Refuse label windows that start too early and label columns among the features.

    Returns one row: rows, labelled rows, date span, feature and label column counts.
    """
    require_columns(panel, ("permno", "formation_date", "ret_1m_fwd", "forward_return_start", "forward_return_end"),
                    "label panel")
    features = list(feature_columns) if feature_columns is not None else default_feature_columns(panel)
    leaked = [c for c in features if c.endswith("_fwd") or c.startswith("forward_return")]
    if leaked:
        raise ValueError(f"label columns among the features: {leaked}")
    figures = label_window_check(panel)
    early = figures.first()["early_windows"]
    if early:
        raise ValueError(f"{early} label windows do not start after their formation date")
    return figures.withColumns({
        "feature_columns": F.lit(len(features)),
        "label_columns": F.lit(len([c for c in panel.columns if c.endswith("_fwd")])),
    })


def label_window_check(panel: DataFrame) -> DataFrame:
    labelled = F.col("ret_1m_fwd").isNotNull()
    start = F.col("forward_return_start")
    early = labelled & (start.isNull() | (start <= F.col("formation_date")))
    return panel.agg(
        F.count(F.lit(1)).alias("rows"), F.count("ret_1m_fwd").alias("labelled_rows"),
        F.count_if(early).alias("early_windows"),
        F.min("formation_date").alias("start_date"), F.max("formation_date").alias("end_date"),
    )


# --- row caps --------------------------------------------------------------------------
# A cap is planned on the per-date row counts, a table of one row per calendar date.  Whole
# dates are then kept by a filter, and a partly kept date by the key value at its quota.

def _date_counts(panel: DataFrame) -> DataFrame:
    return stage(panel.where(F.col("formation_date").isNotNull()).groupBy("formation_date").agg(F.count(F.lit(1)).alias("n")), "date_counts")


def _keep_quota(panel: DataFrame, quotas: DataFrame) -> DataFrame:
    """First ``quota`` securities of each date; ``quotas`` has formation_date, n, quota."""
    partial = quotas.where((F.col("quota") > 0) & (F.col("quota") < F.col("n")))
    cut_dates = panel.join(partial.select("formation_date"), "formation_date", "left_semi")
    cuts = pick_ranked(cut_dates, ["formation_date"], "permno", {"last": lambda n: F.col("quota") - 1},
                       group_info=partial.select("formation_date", "quota"))
    cuts = cuts.select("formation_date", F.col("value").cast("long").alias("_cut"))
    limits = quotas.where(F.col("quota") > 0).join(cuts, "formation_date", "left").select("formation_date", "_cut")
    limits = stage(limits, "limits")
    return panel.join(limits, "formation_date").where(
        F.col("_cut").isNull() | (F.col("permno") <= F.col("_cut"))
    ).drop("_cut")


def cap_chronological(panel: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows by date and security."""
    if max_rows <= 0:
        return panel
    counts = _date_counts(panel)
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("formation_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    quotas = counts.withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(max_rows) - before)))
    return _keep_quota(panel, stage(quotas, "quotas"))


def cap_date_balanced(panel: DataFrame, max_rows: int) -> DataFrame:
    """About the same number of rows from every date, the remainder dealt in date order.

    The level up to which all dates are filled follows from the sorted counts; the rows that
    are left go, one each, to the earliest dates that have more.
    """
    if max_rows <= 0:
        return panel
    counts = _date_counts(panel)
    by_size = Window.orderBy("n", "formation_date")
    smaller = F.coalesce(F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    position = F.row_number().over(by_size) - 1
    dates = F.count(F.lit(1)).over(Window.partitionBy())
    level = F.floor((F.lit(max_rows) - smaller) / (dates - position))
    levels = counts.withColumns({"level": level})
    reached = levels.where(F.col("level") < F.col("n")).agg(F.max("level").alias("level"))
    level_value = reached.first()["level"]
    if level_value is None:
        return panel
    base = F.least(F.col("n"), F.lit(level_value))
    more = (F.col("n") > level_value).cast("int")
    turn = F.sum(more).over(Window.orderBy("formation_date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left_over = F.lit(max_rows) - F.sum(base).over(Window.partitionBy())
    quotas = counts.withColumn("quota", base + F.when((more == 1) & (turn <= left_over), 1).otherwise(0))
    return _keep_quota(panel, stage(quotas, "quotas"))


def cap_rows(panel: DataFrame, max_rows: int, mode: str = "date-balanced") -> DataFrame:
    if mode == "chronological":
        return cap_chronological(panel, max_rows)
    if mode == "date-balanced":
        return cap_date_balanced(panel, max_rows)
    raise ValueError(f"unknown row-cap mode: {mode}")


def cap_whole_periods(panel: DataFrame, max_rows: int, *, min_periods: int = 6) -> DataFrame:
    """The earliest whole dates within the budget, but at least ``min_periods`` of them."""
    if max_rows <= 0:
        return panel
    counts = _date_counts(panel)
    found, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not found or total <= max_rows:
        return panel
    if found < min_periods:
        return cap_chronological(panel, max_rows)
    by_date = Window.orderBy("formation_date")
    running = F.sum("n").over(by_date.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = counts.withColumns({"running": running, "ordinal": F.row_number().over(by_date)}).where(
        (F.col("ordinal") <= min_periods) | (F.col("running") <= max_rows)
    )
    return panel.join(chosen.select("formation_date"), "formation_date", "left_semi")
