import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import features as X
from tests.conftest import rows_of

FUND = ("gvkey string, datadate date, rdq date, niq double, ceqq double, revtq double, atq double, ltq double, dlttq double, "
        "dlcq double, cshoq double, prccq double, epspxq double")
LINK = "gvkey string, lpermno long, linkdt date, linkenddt date, linktype string, linkprim string, usedflag int"


def panel(make, *dates):
    return make("permno long, formation_date date, ret_1m double, market_cap double",
                *[(777, d, 0.06 - 0.015 * (i % 7), 2500.0 + 40 * i * i) for i, d in enumerate(dates)])


def quarters(make):
    return make(FUND, ("52", "2016-09-30", "2016-11-08", 3.0, 24.0, 60.0, 64.0, 40.0, 16.0, 4.0, 6.0, 8.0, 0.5),
                ("000052", "2016-12-31", None, 6.0, 40.0, 75.0, 72.0, 42.0, 18.0, None, 6.0, 10.0, 0.0))


def company(make):
    return make(LINK, ("000052", 777, "2004-06-01", None, "LC", "P", 1), ("000052", 778, "2004-06-01", None, "XX", "P", 1),
                ("000052", 779, "2004-06-01", None, "LU", "C", 0))


def test_fundamentals_wait_for_their_report(make):
    built = X.build_features(panel(make, "2016-10-31", "2016-11-30", "2017-02-28", "2017-03-31"),
                             {"comp_fundq": quarters(make), "ccm_link": company(make)}, ["compustat"])
    got = built.frame.orderBy("formation_date").collect()
    # reported after 39 days; without a report day known on the 90th day
    assert [r["compustat__available_lag_days"] for r in got] == [None, 39.0, 39.0, 90.0]
    assert got[3]["compustat__roe"] == pytest.approx(0.15) and got[1]["compustat__pb"] == pytest.approx(2.0)
    # a missing debt part counts as zero, a zero denominator gives a missing ratio
    assert got[3]["compustat__debt_to_assets"] == pytest.approx(0.25) and got[3]["compustat__pe_proxy"] is None


def test_growth_compares_with_four_rows_before(make):
    rows = [("1", f"{2018 + q // 4}-{3 * (q % 4) + 3:02d}-28", None, 1.0 + q, 1.0, 10.0 + q, *[1.0] * 7) for q in range(6)]
    ratios = {str(r.datadate): r for r in X.fundamental_ratios(make(FUND, *rows)).collect()}
    assert ratios["2018-12-28"]["compustat__revenue_yoy"] is None
    assert ratios["2019-03-28"]["compustat__revenue_yoy"] == pytest.approx(0.4)
    assert ratios["2019-06-28"]["compustat__net_income_yoy"] == pytest.approx(2.0)


def test_primary_link_is_preferred(make):
    links = make(LINK, ("000052", 777, "2004-06-01", None, "LC", "C", 1), ("000052", 777, "2008-06-01", None, "LS", "P", None))
    linked = X.link_fundamentals(X.fundamental_ratios(quarters(make)), links)
    assert rows_of(linked, "gvkey", "datadate", "permno") == [
        ("000052", dt.date(2016, 9, 30), 777), ("000052", dt.date(2016, 12, 31), 777)]


SUMMARY = ("ticker string, statpers date, measure string, meanest double, stdev double, numest double, actual double, "
           "actdats_act date, anndats_act date")
TICKER = "ticker string, permno long, sdate date, edate date, score double"


def test_estimates_by_snapshot_day(make):
    summary = make(SUMMARY, ("qrs ", "2016-11-17", "EPS", 2.0, 0.3, 4.0, 2.5, "2016-11-21", "2016-11-21"),
                   ("QRS", "2016-12-15", "eps", 2.5, 0.2, 8.0, 2.2, None, "2016-12-01"), ("QRS", "2016-12-22", "SAL", 9.0, 1.0, 1.0, 1.0, None, None))
    targets = make("ticker string, statpers date, meanptg double, numup1m double, numdown1m double, numest double",
                   ("QRS", "2016-12-15", 44.0, 2.0, None, 8.0))
    inputs = {"ibes_summary": summary, "ibes_link": make(TICKER, ("QRS", 777, "2012-03-01", None, 1.0)), "ibes_target": targets}
    got = X.build_features(panel(make, "2016-10-31", "2016-11-30", "2016-12-31"), inputs, ["ibes"]).frame.orderBy("formation_date").collect()
    assert [r["ibes__mean_estimate"] for r in got] == [None, 2.0, 2.5]
    # the actual was announced after the first snapshot, before the second
    assert got[1]["ibes__surprise"] is None and got[2]["ibes__surprise"] == pytest.approx(-0.3)
    assert got[2]["ibes__revision_1m"] == pytest.approx(0.25) and got[2]["ibes__estimate_dispersion"] == pytest.approx(0.08)
    assert got[2]["ibes__target_price_mean"] == 44.0 and got[2]["ibes__target_revision_balance_1m"] == pytest.approx(0.25)
    assert got[1]["ibes__target_price_mean"] is None


def test_best_score_and_score_limit(make):
    rows = X.estimate_summary(make(SUMMARY, ("A", "2020-02-15", "EPS", 1.0, 0.1, 5.0, 1.1, None, None)))
    rows = rows.withColumns({n: F.lit(None).cast("double") for n in X.IBES_FEATURES if n not in rows.columns})
    links = make(TICKER, ("a", 1, "2019-01-01", None, 5.0), ("A", 2, "2019-01-01", None, None))
    assert rows_of(X.link_estimates(rows, links), "permno") == [(1,), (2,)]
    assert rows_of(X.link_estimates(rows, links, max_score=5), "permno") == [(1,)]


def test_momentum_skips_the_latest_month(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"permno": np.repeat([1, 2], 20), "k": np.tile(np.arange(20), 2), "ret_1m": rng.normal(0.01, 0.1, 40)})
    pdf.loc[[3, 7, 25], "ret_1m"] = [np.nan, -1.0, np.nan]
    pdf["formation_date"] = [(pd.Timestamp("2018-01-31") + pd.offsets.MonthEnd(k)).date() for k in pdf["k"]]
    pdf["market_cap"] = np.where(pdf.k == 4, 0.0, 100.0)
    df = spark.createDataFrame(pdf).withColumn("ret_1m", F.nanvl("ret_1m", F.lit(None).cast("double")))
    got = X.crsp_features(df).toPandas().sort_values(["permno", "k"]).reset_index(drop=True)
    with np.errstate(divide="ignore"):
        logs = np.log1p(pdf.groupby("permno")["ret_1m"].shift(2)).replace(-np.inf, np.nan)
    for name, rows, least in (("crsp__mom_12_2", 11, 8), ("crsp__mom_6_2", 5, 4)):
        want = np.expm1(logs.groupby(pdf.permno).rolling(rows, min_periods=least).sum().reset_index(level=0, drop=True))
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-12)
    assert got["crsp__log_size"].isna().sum() == 2


MACRO = "date date, rate double, spread double"


def macro(make):
    return make(MACRO, ("2016-11-01", 7.0, 1.5), ("2016-11-29", 8.0, None), ("2016-12-06", 6.0, 2.5))


def test_macro_snapshots_are_known_at_their_month_end(make):
    got = X.add_macro(panel(make, "2016-11-30", "2016-12-31", "2017-01-31"), macro(make)).orderBy("formation_date").collect()
    assert [(r["macro__rate"], r["macro__spread"]) for r in got] == [(8.0, 1.5), (6.0, 2.5), (None, None)]
    # a snapshot of the month end is not yet known on the last trading day before it
    trading = X.add_macro(panel(make, "2016-11-30", "2016-12-30"), macro(make)).orderBy("formation_date").collect()
    assert [r["macro__rate"] for r in trading] == [8.0, None]
    early = X.add_macro(panel(make, "2016-11-15"), macro(make), as_of="formation_date").first()
    assert early["macro__rate"] == 7.0
    with pytest.raises(ValueError):
        X.add_macro(panel(make, "2016-11-15"), macro(make), as_of="any")


def test_families_metadata_and_errors(spark, make):
    p = panel(make, "2016-11-30", "2016-12-31")
    built = X.build_features(p, {"macro_features": macro(make)})
    assert built.skipped == ("compustat", "ibes")
    described = {r.feature for r in X.feature_metadata(spark, built).collect()}
    assert described == {c for c in built.frame.columns if "__" in c}
    with pytest.raises(ValueError, match="unknown feature families"):
        X.build_features(p, {}, ["weather"])
    with pytest.raises(ValueError, match="without metadata"):
        X.feature_metadata(spark, X.FeatureSet(p.withColumn("own__x", F.lit(1))))
    own = {"own": lambda panel, inputs: (panel.select(*X.PANEL_KEY, F.lit(1).alias("own__x")),
                                          X._describe({"own__x": "test"}, "own", "panel", "always"))}
    custom = X.build_features(p, {}, ["crsp", "own"], custom=own)
    assert {r["own__x"] for r in custom.frame.collect()} == {1} and "own__x" in custom.metadata


def test_narrowing_keeps_what_the_panel_can_reach(make):
    inputs = {
        "comp_fundq": make(FUND, *[("52", d, None, *[1.0] * 10) for d in ("2013-10-31", "2016-09-30", "2018-01-31")],
                           ("93", "2016-09-30", None, *[1.0] * 10)),
        "ccm_link": company(make),
        "ibes_link": make(TICKER, ("qrs", 777, "2012-03-01", None, 1.0), ("ZZZ", 9, "2012-03-01", None, 1.0)),
        "ibes_summary": make("ticker string, statpers date", ("QRS", "2016-11-17"), ("ZZZ", "2016-11-17"), ("QRS", "2006-11-17")),
    }
    out = X.narrow_inputs(inputs, panel(make, "2016-11-30", "2016-12-31"))
    assert rows_of(out["comp_fundq"], "gvkey", "datadate") == [("52", dt.date(2016, 9, 30))]
    assert rows_of(out["ccm_link"], "lpermno") == [(777,)]
    assert rows_of(out["ibes_summary"], "ticker") == [("QRS",)]


def test_later_rows_change_no_earlier_feature(make):
    dates = ["2016-11-30", "2016-12-31", "2017-01-31", "2017-02-28", "2017-03-31"]
    inputs = {"comp_fundq": quarters(make), "ccm_link": company(make), "macro_features": macro(make)}
    changed = {
        "comp_fundq": inputs["comp_fundq"].withColumn("niq", F.when(F.col("datadate") > "2016-11-30", 99.0).otherwise(F.col("niq"))),
        "ccm_link": inputs["ccm_link"],
        "macro_features": inputs["macro_features"].where("date < DATE'2016-12-01'"),
    }
    p = panel(make, *dates)
    q = p.withColumn("ret_1m", F.when(F.col("formation_date") > "2016-11-30", 9.0).otherwise(F.col("ret_1m")))
    before, after = (X.build_features(f, i).frame.where("formation_date <= DATE'2016-11-30'") for f, i in ((p, inputs), (q, changed)))
    assert rows_of(before) == rows_of(after)
