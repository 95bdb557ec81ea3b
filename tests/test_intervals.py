import datetime as dt

import numpy as np
import pandas as pd

from factorloom.operators import intervals as I
from tests.conftest import rows_of

NAMES = "permno long, comnam string, ncusip string, ticker string, shrcd int, exchcd int, namedt date, nameenddt date"
LINKS = ("gvkey string, linkprim string, liid string, linktype string, lpermno long, lpermco long, usedflag int, "
         "linkdt date, linkenddt date")


def names(make):
    return make(
        NAMES,
        (10001, "Open", "1", "AAA", 10, 1, "1999-01-01", None),
        (10002, "Closed", "2", "BBB", 11, 3, "1999-01-01", "2003-12-31"),
        (10003, "Share class", "3", "CCC", 12, 1, "1999-01-01", None),
        (10004, "Exchange", "4", "DDD", 10, 4, "1999-01-01", None),
    )


def test_open_and_expired_company_links(make):
    links = make(LINKS, ("001004", "P", "01", "LU", 10001, 1, 1, "2000-01-01", None),
                 ("001009", "P", "01", "LC", 10002, 2, 1, "2000-01-01", "2001-12-31"))
    asked = make("gvkey string, date date", ("001004", "2020-06-30"), ("001009", "2002-01-01"), ("001009", "2001-12-31"))
    got = rows_of(I.resolve_company(asked, links), "gvkey", "date", "permno")
    assert got == [("001004", dt.date(2020, 6, 30), 10001), ("001009", dt.date(2001, 12, 31), 10002)]


def test_earliest_link_wins_before_primary_rank(make):
    links = make(LINKS, ("1", "C", "01", "LC", 10001, 1, 1, "2000-01-01", "2001-12-31"),
                 ("1", "P", "01", "LU", 10002, 1, 1, "2000-06-01", "2002-12-31"))
    asked = make("gvkey string, date date", ("1", "2000-07-01"))
    assert I.resolve_company(asked, links).first()["permno"] == 10001
    assert I.overlap_count(links, ["gvkey"], "linkdt", "linkenddt").first()[0] == 1


def test_ticker_is_reused_and_scores_are_filtered(make):
    links = make("ticker string, permno long, sdate date, edate date, score double",
                 ("XYZ", 10001, "2000-01-01", "2004-12-31", 0.0), ("xyz ", 10002, "2005-01-01", None, 1.0),
                 ("BBB", 10003, "2000-01-01", None, 2.0))
    asked = make("ticker string, date date", ("xyz", "2001-06-30"), (" XYZ", "2006-06-30"), ("BBB", "2001-01-31"))
    assert rows_of(I.resolve_ticker(asked, links), "ticker", "permno") == [("XYZ", 10001), ("XYZ", 10002)]


def test_identifiers_need_a_listed_security(make):
    links = make(LINKS, *[(g, "P", "01", "LC", p, 1, 1, "2000-01-01", None)
                          for g, p in (("GOOD", 10001), ("SHARE", 10003), ("EXCH", 10004))])
    tickers = make("ticker string, permno long, sdate date, edate date, score double", ("AAA", 10001, "2000-01-01", None, 1.0))
    asked = make("kind string, identifier string, date date", ("gvkey", "GOOD", "2001-01-31"), ("gvkey", "SHARE", "2001-01-31"),
                 ("gvkey", "EXCH", "2001-01-31"), ("permno", "10002", "2004-01-31"), ("permno", "10002", "2003-01-31"),
                 ("ibes_ticker", "aaa", "2001-01-31"))
    got = {(k, i, str(d)): p for k, i, d, p in rows_of(
        I.resolve_identifiers(asked, names(make), links, tickers), "kind", "identifier", "date", "permno")}
    assert got == {
        ("gvkey", "GOOD", "2001-01-31"): 10001, ("gvkey", "SHARE", "2001-01-31"): None, ("gvkey", "EXCH", "2001-01-31"): None,
        ("permno", "10002", "2004-01-31"): None, ("permno", "10002", "2003-01-31"): 10002, ("ibes_ticker", "aaa", "2001-01-31"): 10001,
    }


def test_link_tables_and_diagnostics(make):
    links = make(LINKS, ("GOOD", "P", "01", "LC", 10001, 1, 1, "2000-01-01", None),
                 ("PART", "P", "01", "LC", 10002, 1, 1, "2002-01-01", None),
                 ("SHARE", "P", "01", "LC", 10003, 2, 1, "2000-01-01", None),
                 ("NONE", "P", "01", "LC", None, 2, 1, "2000-01-01", None))
    built = I.company_links(links, names(make))
    assert rows_of(built, "gvkey", "permno", "valid_start", "valid_end") == [
        ("GOOD", 10001, dt.date(2000, 1, 1), None), ("PART", 10002, dt.date(2002, 1, 1), dt.date(2003, 12, 31)),
    ]
    found = I.link_diagnostics(links, built, source_id="lpermno", row_key=["gvkey", "linkdt"], keys=["gvkey"],
                               start="linkdt", end="linkenddt").first()
    assert (found.total_count, found.matched_count, found.unmatched_count, found.overlap_count) == (3, 2, 1, 0)
    assert found.unmatched_rate == 1 / 3


def test_estimate_links_drop_bad_scores(make):
    links = make("ticker string, permno long, ncusip string, sdate date, edate date, score double",
                 ("AAA", 10001, "1", "2000-01-01", None, 1.0), ("BBB", 10002, "2", "2000-01-01", None, 2.0),
                 ("CCC", 10002, "2", "2000-01-01", None, None))
    assert rows_of(I.estimate_links(links, names(make)), "ibes_ticker", "crsp_ticker") == [("AAA", "AAA")]


def naive_overlaps(rows):
    count = 0
    for key in {r[0] for r in rows}:
        latest = None
        for _, start, end in sorted(r for r in rows if r[0] == key):
            count += latest is not None and start <= latest
            latest = end if latest is None else max(latest, end)
    return count


def test_overlap_count_equals_the_row_loop(spark):
    rng = np.random.default_rng(5)
    day = np.datetime64("2000-01-01")
    start = rng.integers(0, 60, 500)
    # some intervals end before they start
    pdf = pd.DataFrame({"k": rng.integers(0, 8, 500), "s": day + start, "e": day + start + rng.integers(-3, 6, 500)})
    pdf.loc[pdf.index % 3 == 0, "k"] = 1  # a hot group
    df = spark.createDataFrame(pdf.assign(s=pdf.s.dt.date, e=pdf.e.dt.date))
    rows = [(k, s, e) for k, s, e in zip(pdf.k, pdf.s, pdf.e)]
    assert I.overlap_count(df, ["k"], "s", "e").first()[0] == naive_overlaps(rows)


def test_asof_takes_the_latest_known_row(spark, make):
    rng = np.random.default_rng(6)
    day = pd.Timestamp("2020-01-01")
    left = pd.DataFrame({"permno": rng.integers(0, 5, 200), "d": day + pd.to_timedelta(rng.integers(0, 300, 200), "D")}).drop_duplicates()
    right = pd.DataFrame({"permno": rng.integers(0, 4, 80), "a": day + pd.to_timedelta(rng.integers(0, 300, 80), "D")}).drop_duplicates()
    right["x"] = np.where(rng.random(len(right)) < 0.3, np.nan, rng.random(len(right)))
    right["n"] = np.arange(len(right))
    to_dates = lambda p, c: p.assign(**{c: p[c].dt.date})
    l = spark.createDataFrame(to_dates(left, "d"))
    r = spark.createDataFrame(to_dates(right, "a")).selectExpr("permno", "a AS available_date", "nullif(x, 'NaN') AS x", "n")
    got = I.asof_backward(l, [(r, ["x", "n"])], key="permno", left_date="d").toPandas()
    want = pd.merge_asof(left.sort_values("d"), right.sort_values("a"), left_on="d", right_on="a", by="permno")
    got["d"] = pd.to_datetime(got["d"])
    joined = got.merge(want, on=["permno", "d"])
    assert len(joined) == len(left)
    for c in ("x", "n"):
        np.testing.assert_array_equal(joined[f"{c}_x"].astype(float), joined[f"{c}_y"].astype(float))


def test_unmatched_rows(make):
    months = make("permno long, date date", (10001, "2001-01-31"), (10002, "2004-01-31"))
    missing = I.unmatched_rows(months, I.resolve_names(months, names(make)), ["permno", "date"])
    assert rows_of(missing, "permno") == [(10002,)]
