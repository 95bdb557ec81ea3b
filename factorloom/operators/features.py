"""Feature families: price, fundamentals, estimates and macro, all point in time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    as_date, as_long, as_number, closed_end, normalized_text, safe_divide, zero_padded,
)
from ..plans.staging import fixed_table, stage
from ..sources.contracts import require_columns
from .intervals import asof_backward, first_match, join_active

PANEL_KEY = ["permno", "formation_date"]

# Output columns of each family, with the kind of signal they carry.
CRSP_FEATURES = {
    "crsp__mom_12_2": "momentum", "crsp__mom_6_2": "momentum",
    "crsp__reversal_1m": "reversal", "crsp__log_size": "size",
}
COMPUSTAT_FEATURES = {
    "compustat__pb": "valuation", "compustat__pe_proxy": "valuation", "compustat__roe": "quality",
    "compustat__debt_to_assets": "quality", "compustat__liabilities_to_assets": "quality",
    "compustat__revenue_yoy": "growth", "compustat__net_income_yoy": "growth",
    "compustat__available_lag_days": "availability",
}
IBES_FEATURES = {
    "ibes__mean_estimate": "estimates", "ibes__estimate_dispersion": "estimates",
    "ibes__num_estimates": "estimates", "ibes__revision_1m": "revisions", "ibes__surprise": "surprises",
    "ibes__target_price_mean": "target_price", "ibes__target_revision_balance_1m": "target_price",
}
# Fixed value: how far before the first panel date raw fundamentals and estimates may lie.
LOOKBACK_DAYS = 730


@dataclass(frozen=True)
class FeatureSet:
    """A panel with features, what each feature is, and the families without inputs."""

    frame: DataFrame
    metadata: dict[str, dict[str, str]] = field(default_factory=dict)
    skipped: tuple[str, ...] = ()


def _describe(features: Mapping[str, str], family: str, source: str, rule: str) -> dict[str, dict[str, str]]:
    return {
        name: {"feature": name, "feature_family": family, "kind": kind, "source_table": source,
               "availability_rule": rule}
        for name, kind in features.items()
    }


# --- price -----------------------------------------------------------------------------

def _skipped_momentum(rows: int, at_least: int):
    """Compounded return of ``rows`` rows that end two rows back.

    log1p is NULL for a return of -1 or less, so such rows do not count."""
    frame = Window.partitionBy("permno").orderBy("formation_date").rowsBetween(-(rows + 1), -2)
    log_return = F.when(F.col("ret_1m") > -1, F.log1p("ret_1m"))
    return F.when(F.count(log_return).over(frame) >= at_least, F.expm1(F.sum(log_return).over(frame)))


def crsp_features(panel: DataFrame) -> DataFrame:
    require_columns(panel, [*PANEL_KEY, "ret_1m", "market_cap"], "panel")
    return panel.withColumns(
        {
            "crsp__mom_12_2": _skipped_momentum(11, 8),
            "crsp__mom_6_2": _skipped_momentum(5, 4),
            "crsp__reversal_1m": F.col("ret_1m"),
            "crsp__log_size": F.when(F.col("market_cap") > 0, F.ln("market_cap")),
        }
    )


# --- fundamentals ----------------------------------------------------------------------

_FUNDAMENTALS = ("oiadpq", "niq", "ceqq", "revtq", "atq", "ltq", "dlttq", "dlcq", "cshoq", "prccq", "epspxq", "saleq")


def _numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: as_number(n) if n in df.columns else F.lit(None).cast("double") for n in names})


def fundamental_ratios(fundamentals: DataFrame, *, fallback_days: int = 90) -> DataFrame:
    """Ratios per company and quarter, with the day they became known.

    A quarter is known on its report day, or ``fallback_days`` after its end."""
    q = _numbers(fundamentals, _FUNDAMENTALS).withColumns(
        {"gvkey": zero_padded("gvkey"), "datadate": as_date(fundamentals, "datadate"),
         "rdq": as_date(fundamentals, "rdq")}
    )
    # a row without company can't be linked; all of them would share one window
    q = q.where(F.col("gvkey").isNotNull() & (F.col("gvkey") != ""))
    q = q.withColumn("available_date", F.coalesce("rdq", F.date_add("datadate", fallback_days)))
    equity, assets = F.col("ceqq"), F.col("atq")
    debt = F.coalesce("dlttq", F.lit(0.0)) + F.coalesce("dlcq", F.lit(0.0))
    a_year_ago = Window.partitionBy("gvkey").orderBy("datadate")

    def growth(name: str):
        prior = F.lag(name, 4).over(a_year_ago)
        return safe_divide(F.col(name) - prior, F.abs(prior))

    ratios = {
        "compustat__pb": safe_divide(F.col("prccq") * F.col("cshoq"), equity),
        "compustat__pe_proxy": safe_divide(F.col("prccq"), F.col("epspxq")),
        "compustat__roe": safe_divide(F.col("niq"), equity),
        "compustat__debt_to_assets": safe_divide(debt, assets),
        "compustat__liabilities_to_assets": safe_divide(F.col("ltq"), assets),
        "compustat__revenue_yoy": growth("revtq"),
        "compustat__net_income_yoy": growth("niq"),
        "compustat__available_lag_days": F.datediff("available_date", "datadate").cast("double"),
    }
    return q.select("gvkey", "datadate", "available_date", *[c.alias(n) for n, c in ratios.items()])


def link_fundamentals(quarters: DataFrame, links: DataFrame) -> DataFrame:
    """Quarters of every security whose used link covers the quarter end.

    One row per (company, quarter, security): the primary link first."""
    link = links.withColumns(
        {"gvkey": zero_padded("gvkey"), "permno": as_long("lpermno"), "linkdt": as_date(links, "linkdt"),
         "linkenddt": as_date(links, "linkenddt")}
    )
    if "usedflag" in links.columns:
        link = link.where(F.coalesce(as_number("usedflag"), F.lit(1.0)).cast("int") == 1)
    if "linktype" in links.columns:
        link = link.where(F.col("linktype").isin("LC", "LU", "LS"))
    rank = F.lit(0)
    if "linkprim" in links.columns:
        rank = F.when(F.col("linkprim") == "P", 0).when(F.col("linkprim") == "C", 1).otherwise(2)
    link = link.where(F.col("permno").isNotNull()).select("gvkey", "permno", "linkdt", "linkenddt", rank.alias("_rank"))
    active = join_active(quarters, link, "gvkey", "datadate", "linkdt", "linkenddt").repartition("permno")
    return first_match(active, ["gvkey", "datadate", "permno"], [F.col("_rank")],
                       ["available_date", *COMPUSTAT_FEATURES])


def known_fundamentals(fundamentals: DataFrame, links: DataFrame, **options) -> DataFrame:
    """One row per security and availability day; the latest quarter wins."""
    linked = link_fundamentals(fundamental_ratios(fundamentals, **options), links)
    linked = linked.where(F.col("available_date").isNotNull())
    return first_match(linked, ["permno", "available_date"], [F.col("datadate"), F.col("gvkey")],
                       list(COMPUSTAT_FEATURES), last=True)


# --- estimates -------------------------------------------------------------------------

def _optional_date(df: DataFrame, name: str):
    return as_date(df, name) if name in df.columns else F.lit(None).cast("date")


def estimate_summary(summary: DataFrame, *, partition_by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Consensus features per ticker and snapshot day, for the EPS measure.

    The revision compares with the previous row of the same ``partition_by``; rows of one
    day are taken in the order of their mean and count.  A surprise exists only once the
    actual has been announced."""
    s = _numbers(summary, ("meanest", "stdev", "numest", "actual")).withColumns(
        {"ticker": normalized_text("ticker"), "statpers": as_date(summary, "statpers"),
         "_known": F.coalesce(_optional_date(summary, "actdats_act"), _optional_date(summary, "anndats_act"))}
    )
    if "measure" in summary.columns:
        s = s.where(F.upper("measure") == "EPS")
    s = s.where(F.col("ticker").isNotNull() & (F.col("ticker") != ""))  # can't be linked, and would share one window
    mean = F.col("meanest")
    prior = F.lag("meanest", 1).over(Window.partitionBy(*partition_by).orderBy("statpers", "meanest", "numest"))
    return s.select(
        "ticker", F.col("statpers").alias("available_date"),
        mean.alias("ibes__mean_estimate"),
        safe_divide(F.col("stdev"), F.abs(mean)).alias("ibes__estimate_dispersion"),
        F.col("numest").alias("ibes__num_estimates"),
        safe_divide(mean - prior, F.abs(prior)).alias("ibes__revision_1m"),
        F.when(F.col("_known") <= F.col("statpers"), F.col("actual") - mean).alias("ibes__surprise"),
    )


def estimate_targets(targets: DataFrame) -> DataFrame:
    t = _numbers(targets, ("meanptg", "numup1m", "numdown1m", "numest")).withColumns(
        {"ticker": normalized_text("ticker"), "statpers": as_date(targets, "statpers")}
    )
    balance = F.coalesce("numup1m", F.lit(0.0)) - F.coalesce("numdown1m", F.lit(0.0))
    return t.select(
        "ticker", F.col("statpers").alias("available_date"), F.col("meanptg").alias("ibes__target_price_mean"),
        safe_divide(balance, F.col("numest")).alias("ibes__target_revision_balance_1m"),
    )


def link_estimates(rows: DataFrame, links: DataFrame, *, max_score: float | None = None) -> DataFrame:
    """Estimate rows of every security whose ticker link covers the day, best score first."""
    link = links.withColumns({"ticker": normalized_text("ticker"), "permno": as_long("permno"),
                              "sdate": as_date(links, "sdate"), "edate": as_date(links, "edate")})
    score = F.lit(0.0)
    if "score" in links.columns:
        score = F.coalesce(as_number("score"), F.lit(999.0))
    link = link.where(F.col("permno").isNotNull()).select("ticker", "permno", "sdate", "edate", score.alias("_score"))
    if max_score is not None:
        link = link.where(F.col("_score") <= max_score)
    # the matches by day and the as-of pass after them keep to this one shuffle
    active = join_active(rows, link, "ticker", "available_date", "sdate", "edate").repartition("permno")
    return first_match(active, ["ticker", "available_date", "permno"], [F.col("_score")], list(IBES_FEATURES))


def known_estimates(
    summary: DataFrame, links: DataFrame, targets: DataFrame | None = None, *, max_score: float | None = None,
    partition_by: Sequence[str] = ("ticker",),
) -> DataFrame:
    """One row per security and snapshot day from consensus and price targets."""
    rows = estimate_summary(summary, partition_by=partition_by).where(F.col("available_date").isNotNull())
    if targets is not None:
        target_rows = estimate_targets(targets).where(F.col("available_date").isNotNull())
        rows = rows.join(target_rows, ["ticker", "available_date"], "full")
    else:
        rows = rows.withColumns({n: F.lit(None).cast("double") for n in IBES_FEATURES if n not in rows.columns})
    linked = link_estimates(rows, links, max_score=max_score)
    return first_match(linked, ["permno", "available_date"], [F.col("ticker")], list(IBES_FEATURES), last=True)


# --- macro -----------------------------------------------------------------------------

def macro_month_end(macro: DataFrame) -> DataFrame:
    """Last known value of each series per calendar month, stamped at the month end."""
    require_columns(macro, ["date"], "macro table")
    values = [c for c in macro.columns if c != "date"]
    dated = macro.withColumn("date", as_date(macro, "date")).where(F.col("date").isNotNull())
    last_known = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"macro__{c}") for c in values
    ]
    return dated.groupBy(F.last_day("date").alias("formation_date")).agg(*last_known)


def add_macro(panel: DataFrame, macro: DataFrame, *, as_of: str = "month_end") -> DataFrame:
    """Macro snapshot of each panel date.

    By default a snapshot is known at the calendar month end and joined by that date, so a
    panel date before it gets none.  ``as_of="formation_date"`` uses, per date, what was
    known by then in its month.  Neither looks ahead.  Monthly snapshots are one row per
    month, daily ones one row per panel date.
    """
    if as_of not in ("month_end", "formation_date"):
        raise ValueError(f"unknown macro timing: {as_of}")
    if as_of == "formation_date":
        values = [c for c in macro.columns if c != "date"]
        dated = macro.withColumn("date", as_date(macro, "date")).where(F.col("date").isNotNull())
        dates = stage(panel.select("formation_date").distinct(), "panel_dates")
        known = dated.join(dates, F.last_day("date") == F.last_day("formation_date")).where(
            F.col("date") <= F.col("formation_date")
        )
        snapshots = known.groupBy("formation_date").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"macro__{c}") for c in values]
        )
        return panel.join(stage(snapshots, "macro"), "formation_date", "left")
    return panel.join(stage(macro_month_end(macro), "macro"), "formation_date", "left")


# --- narrowing and assembly ------------------------------------------------------------

def narrow_inputs(
    inputs: Mapping[str, DataFrame], panel: DataFrame, *, lookback_days: int = LOOKBACK_DAYS
) -> dict[str, DataFrame]:
    """Keep raw rows that can reach the panel: its securities, and its dates plus look-back.

    Rows older than ``lookback_days`` before the first panel date are left out."""
    out = dict(inputs)
    first, last = panel.agg(F.min("formation_date"), F.max("formation_date")).first()
    if first is None:
        return out
    low, high = F.date_sub(F.lit(first), lookback_days), F.lit(last)
    securities = panel.select(F.col("permno").alias("_p")).distinct()
    if "ccm_link" in out:
        out["ccm_link"] = out["ccm_link"].join(securities, as_long("lpermno") == F.col("_p"), "left_semi")
    if "comp_fundq" in out:
        fund = out["comp_fundq"].where(as_date(out["comp_fundq"], "datadate").between(low, high))
        if "ccm_link" in out:
            linked = out["ccm_link"].select(zero_padded("gvkey").alias("_g")).distinct()
            fund = fund.join(linked, zero_padded("gvkey") == F.col("_g"), "left_semi")
        out["comp_fundq"] = fund
    if "ibes_link" in out:
        out["ibes_link"] = out["ibes_link"].join(securities, as_long("permno") == F.col("_p"), "left_semi")
    for name in ("ibes_summary", "ibes_target"):
        if name in out:
            rows = out[name].where(as_date(out[name], "statpers").between(low, high))
            if "ibes_link" in out:
                tickers = out["ibes_link"].select(normalized_text("ticker").alias("_t")).distinct()
                rows = rows.join(tickers, normalized_text("ticker") == F.col("_t"), "left_semi")
            out[name] = rows
    return out


def on_panel_dates(features: DataFrame, panel: DataFrame) -> DataFrame:
    """Feature rows whose date is one of the panel's dates."""
    dated = features.withColumn("formation_date", as_date(features, "formation_date"))
    return dated.join(panel.select("formation_date").dropna().distinct(), "formation_date", "left_semi")


# The families in their order, and the tables each one cannot do without.
FAMILIES: dict[str, tuple[str, ...]] = {
    "macro": ("macro_features",), "crsp": (), "compustat": ("comp_fundq", "ccm_link"),
    "ibes": ("ibes_summary", "ibes_link"),
}
CustomFamily = Callable[[DataFrame, Mapping[str, DataFrame]], tuple[DataFrame, dict[str, dict[str, str]]]]


def build_features(
    panel: DataFrame, inputs: Mapping[str, DataFrame], families: Sequence[str] | None = None, *,
    custom: Mapping[str, CustomFamily] | None = None, macro_as_of: str = "month_end",
) -> FeatureSet:
    """Add the requested families to the panel; families without inputs are skipped.

    Fundamentals and estimates share one as-of pass, so the panel is shuffled by security
    once for both; the price windows use the same partitioning, macro is a small join.
    """
    custom = custom or {}
    requested = list(families) if families is not None else [*FAMILIES, *custom]
    unknown = sorted(set(requested) - set(FAMILIES) - set(custom))
    if unknown:
        raise ValueError(f"unknown feature families: {unknown}")
    skipped = tuple(f for f in requested if any(t not in inputs for t in FAMILIES.get(f, ())))
    active = [f for f in requested if f not in skipped]

    frame, metadata = panel, {}
    rights: list[tuple[DataFrame, Sequence[str]]] = []
    if "compustat" in active:
        rights.append((known_fundamentals(inputs["comp_fundq"], inputs["ccm_link"]), list(COMPUSTAT_FEATURES)))
        metadata |= _describe(COMPUSTAT_FEATURES, "compustat", "comp_fundq via ccm_link",
                              "report day, else 90 days after the quarter end")
    if "ibes" in active:
        rows = known_estimates(inputs["ibes_summary"], inputs["ibes_link"], inputs.get("ibes_target"))
        rights.append((rows, list(IBES_FEATURES)))
        metadata |= _describe(IBES_FEATURES, "ibes", "ibes_summary and ibes_target via ibes_link",
                              "snapshot day; a surprise needs an announced actual")
    if rights:
        frame = asof_backward(frame, rights, key="permno", left_date="formation_date")
    if "crsp" in active:
        frame = crsp_features(frame)
        metadata |= _describe(CRSP_FEATURES, "crsp", "monthly panel", "values of the formation month and before")
    if "macro" in active:
        macro = inputs["macro_features"]
        frame = add_macro(frame, macro, as_of=macro_as_of)
        names = {f"macro__{c}": "macro" for c in macro.columns if c != "date"}
        metadata |= _describe(names, "macro", "macro_features", "month end of the calendar month, or known by the panel date")
    for name in active:
        if name in custom:
            built, described = custom[name](panel, inputs)
            frame = frame.join(built, PANEL_KEY, "left")
            metadata |= described
    return FeatureSet(frame, metadata, skipped)


def feature_metadata(spark: SparkSession, features: FeatureSet) -> DataFrame:
    """One row per feature; refuses a feature column nobody described."""
    present = [c for c in features.frame.columns if "__" in c]
    missing = sorted(set(present) - set(features.metadata))
    if missing:
        raise ValueError(f"features without metadata: {missing}")
    columns = ["feature", "feature_family", "kind", "source_table", "availability_rule"]
    rows = [tuple(features.metadata[name][c] for c in columns) for name in present]
    return fixed_table(spark, rows, ", ".join(f"{c} string" for c in columns))
