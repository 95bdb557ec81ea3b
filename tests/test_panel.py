import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorloom.operators import panel as P
from tests.conftest import rows_of
from tests.test_intervals import NAMES

MONTHLY = ("permno long, permco long, date date, prc double, ret double, retx double, shrout double, vol double, "
           "cfacpr double, cfacshr double")


def monthly(make):
    ends = ["2020-01-31", "2020-02-29", "2020-03-31", "2020-04-30", "2020-05-31", "2020-06-30"]
    ret = [0.01, 0.02, -0.01, 0.03, 0.04, 0.05]
    rows = [(10001, 1, d, (-10.0 if i == 0 else 10.0 + i), r, r, 100.0 + i, 1000.0, 2.0, 1.0) for i, (d, r) in enumerate(zip(ends, ret))]
    rows += [(10002, 2, "2020-01-31", 20.0, 0.1, 0.1, 50.0, 500.0, 1.0, 1.0), (10002, 2, "2020-02-29", 21.0, 0.2, 0.2, 51.0, 600.0, 0.0, 1.0)]
    return make(MONTHLY, *rows)


def names(make):
    return make(NAMES, (10001, "In", "1", "A", 10, 1, "2019-01-01", None), (10002, "Share class", "2", "B", 12, 1, "2019-01-01", None),
                (10003, "Exchange", "3", "C", 10, 4, "2019-01-01", None), (10004, "Later", "4", "D", 11, 3, "2021-01-01", None))


def test_forward_returns(make):
    labels = {(r.permno, str(r.formation_date)): r for r in P.forward_returns(monthly(make)).collect()}
    first = labels[10001, "2020-01-31"]
    assert first.ret_1m_fwd == pytest.approx(0.02)
    assert first.ret_3m_fwd == pytest.approx(1.02 * 0.99 * 1.03 - 1)
    assert first.forward_return_start == first.forward_return_end == dt.date(2020, 2, 29)
    assert first.forward_return_end_3m == dt.date(2020, 4, 30)
    assert first.ret_6m_fwd is None and first.forward_return_end_6m is None
    assert labels[10001, "2020-04-30"].ret_3m_fwd is None and labels[10001, "2020-06-30"].ret_1m_fwd is None


def test_missing_return_voids_the_window(make):
    gap = monthly(make).withColumn("ret", F.when(F.col("date") != "2020-03-31", F.col("ret")))
    labels = {(r.permno, str(r.formation_date)): r for r in P.forward_returns(gap).collect()}
    assert labels[10001, "2020-01-31"].ret_3m_fwd is None and labels[10001, "2020-02-29"].ret_1m_fwd is None
    assert labels[10001, "2020-03-31"].ret_3m_fwd == pytest.approx(1.03 * 1.04 * 1.05 - 1)


def test_contiguous_months_can_be_required(make):
    rows = monthly(make).where("date != DATE'2020-03-31'")
    loose = {str(r.formation_date): r.ret_1m_fwd for r in P.forward_returns(rows).where("permno = 10001").collect()}
    strict = {str(r.formation_date): r.ret_1m_fwd
              for r in P.forward_returns(rows, require_contiguous_months=True).where("permno = 10001").collect()}
    assert loose["2020-02-29"] == pytest.approx(0.03) and strict["2020-02-29"] is None
    assert strict["2020-01-31"] == pytest.approx(0.02)


def test_horizon_errors(make):
    for horizons in ((), (3, 6)):
        with pytest.raises(ValueError):
            P.forward_returns(monthly(make), horizons)


def test_universe_values_and_filter(make):
    got = P.monthly_universe(monthly(make), names(make), start="2020-01-31", end="2020-03-31")
    assert rows_of(got, "permno", "shrcd", "exchcd") == [(10001, 10, 1)] * 3
    first = got.where("formation_date = DATE'2020-01-31'").first()
    assert (first.price, first.adjusted_price, first.market_cap) == (10.0, 5.0, 10.0 * 100 * 1000)


def test_last_started_name_period_wins(make):
    both = make(NAMES, (10001, "Old", "1", "A", 10, 1, "2019-01-01", None), (10001, "New", "1", "A", 11, 2, "2020-02-01", None))
    got = rows_of(P.monthly_universe(monthly(make), both), "formation_date", "shrcd", order=["formation_date"])
    assert got[0][1] == 10 and {s for _, s in got[1:]} == {11}


def test_panel_and_its_checks(make):
    panel = P.monthly_panel(monthly(make), names(make))
    figures = P.check_labels(panel).first()
    assert (figures["rows"], figures["labelled_rows"], figures["label_columns"]) == (6, 5, 3)
    bad = panel.withColumn("forward_return_start", F.col("formation_date"))
    with pytest.raises(ValueError, match="do not start after"):
        P.check_labels(bad)
    with pytest.raises(ValueError, match="label columns among"):
        P.check_labels(panel, feature_columns=["market_cap", "ret_1m_fwd"])
    assert "ret_1m_fwd" not in P.default_feature_columns(panel)


def test_repeated_monthly_rows_are_refused(make):
    twice = monthly(make).unionByName(monthly(make))
    with pytest.raises(ValueError, match="repeat the key"):
        P.monthly_panel(twice, names(make))


def cap_panel(spark, sizes):
    return spark.createDataFrame(
        [(dt.date(2020, m + 1, 28), p) for m, n in enumerate(sizes) for p in range(n)], "formation_date date, permno long"
    )


def naive_balanced(sizes, cap):
    order = sorted((k, d) for d, n in enumerate(sizes) for k in range(n))[:cap]
    return sorted((d, k) for k, d in order)


@pytest.mark.parametrize("sizes,cap", [([10] * 6, 24), ([10] * 6, 20), ([1, 7, 3, 9], 10), ([2, 2, 8], 7), ([5, 5], 100), ([3, 4, 5], 2)])
def test_balanced_cap_equals_dealing_rows(spark, sizes, cap):
    got = P.cap_rows(cap_panel(spark, sizes), cap).collect()
    assert sorted((r.formation_date.month - 1, r.permno) for r in got) == naive_balanced(sizes, cap)


def test_chronological_and_whole_period_caps(spark):
    df = cap_panel(spark, [10] * 6)
    assert df.count() == 60
    assert sorted({r.formation_date.month for r in P.cap_rows(df, 25, "chronological").collect()}) == [1, 2, 3]
    assert P.cap_rows(df, 25, "chronological").count() == 25
    assert P.cap_whole_periods(df, 35, min_periods=3).count() == 30
    assert P.cap_whole_periods(df, 15, min_periods=3).count() == 30
    assert P.cap_whole_periods(df, 15).count() == 60
    assert P.cap_whole_periods(cap_panel(spark, [10] * 3), 15).count() == 15
    with pytest.raises(ValueError):
        P.cap_rows(df, 5, "random")


def test_caps_keep_large_ids_apart(spark):
    base = 1 << 60
    rows = [(dt.date(2020, 1, 31), base + k) for k in range(6)]
    df = spark.createDataFrame(rows, "formation_date date, permno long")
    assert sorted(r.permno - base for r in P.cap_chronological(df, 2).collect()) == [0, 1]
    assert sorted(r.permno - base for r in P.cap_date_balanced(df, 5).collect()) == [0, 1, 2, 3, 4]
