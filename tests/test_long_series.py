import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import hashtree as H
from factorloom.operators import intervalbins as N
from factorloom.operators import intervals as I
from factorloom.operators import longseries as G
from factorloom.operators import metrics as M
from factorloom.plans.rangescan import RANGE, cut_into_ranges, scan
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def one_key(spark):
    """One key with nearly all rows, a small one and rows without a key; some values are missing."""
    draw = random.Random(7)
    rows = [
        ("hot" if i % 50 else ("cold" if i % 100 else None), i, None if draw.random() < 0.2 else draw.randint(-40, 60) / 1000.0)
        for i in range(3000)
    ]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "key string, place int, value double")


def test_scan_equals_plain_loop(one_key):
    cut = cut_into_ranges(one_key, ["key"], ["place"], ranges=7)
    out = scan(cut, ["key"], ["place"], {
        "latest": ("last", "value"), "total": ("sum", "value"), "lowest": ("min", "value"), "highest": ("max", "value"),
    }).collect()
    assert len({r[RANGE] for r in out if r["key"] == "hot"}) >= 6
    state = {}
    for r in sorted(out, key=lambda r: r["place"]):
        last, total, low, high = state.get(r["key"], (None, None, None, None))
        v = r["value"]
        if v is not None:
            last, total = v, (total or 0.0) + v
            low, high = (v if low is None else min(low, v)), (v if high is None else max(high, v))
        state[r["key"]] = (last, total, low, high)
        assert (r["latest"], r["lowest"], r["highest"]) == (last, low, high)
        assert r["total"] is None and total is None or r["total"] == pytest.approx(total)
    assert len(out) == 3000


def test_scan_of_an_empty_table_and_taken_names(one_key):
    none = cut_into_ranges(one_key.where("false"), ["key"], ["place"])
    assert scan(none, ["key"], ["place"], {"latest": ("last", "value")}).count() == 0
    with pytest.raises(ValueError):
        cut_into_ranges(one_key.withColumn(RANGE, F.lit(1)), ["key"], ["place"])
    with pytest.raises(ValueError):
        scan(none, ["key"], ["place"], {"value": ("sum", "value")})
    with pytest.raises(ValueError):
        scan(none, ["key"], ["place"], {"m": ("median", "value")})


def test_drawdown_equals_window_version(one_key):
    got = G.max_drawdown_ranged(one_key, ["key"], value="value", order=["place"], ranges=9)
    expected = M.max_drawdown(one_key, ["key"], value="value", order="place")
    got = {r["key"]: r["max_drawdown"] for r in got.collect()}
    expected = {r["key"]: r["max_drawdown"] for r in expected.collect()}
    assert set(got) == {"hot", "cold", None} and got == pytest.approx(expected)


def test_a_total_loss_stays_lost(make):
    rows = make("key string, place int, value double", *[("a", i, -1.0 if i == 3 else 0.1) for i in range(12)])
    curve = G.equity_curve(rows, ["key"], value="value", order=["place"], ranges=5).orderBy("place").collect()
    assert [r["equity"] for r in curve[3:]] == [0.0] * 9 and curve[-1]["drawdown"] == -1.0


def test_asof_equals_window_version(spark):
    draw = random.Random(3)
    left = spark.createDataFrame(
        [("hot" if i % 20 else None, f"2020-0{draw.randint(1, 9)}-{draw.randint(10, 28)}", i) for i in range(800)]
        + [("hot", "2020-05-05", i) for i in range(800, 1200)], "key string, day string, id int",
    ).withColumn("day", F.to_date("day"))
    days = sorted({f"2020-0{draw.randint(1, 9)}-{draw.randint(10, 28)}" for _ in range(60)})
    right = spark.createDataFrame(
        [("hot", d, None if n % 3 else float(n), n) for n, d in enumerate(days)], "key string, available_date string, a double, b int"
    ).withColumn("available_date", F.to_date("available_date"))
    other = right.where("b % 7 = 0").select("key", "available_date", F.col("b").alias("c"))
    sides = [(right, ["a", "b"]), (other, ["c"])]
    got = G.asof_backward_ranged(left, sides, key="key", left_date="day", ranges=8)
    expected = I.asof_backward(left, sides, key="key", left_date="day")
    assert got.columns == expected.columns and rows_of(got) == rows_of(expected)


SPANS = "id string, start date, stop date, tag int"
SPAN_ROWS = [
    ("a", "2000-01-01", None, 1), ("a", "2000-01-01", "2000-01-01", 2), ("a", "1850-06-01", "1905-01-01", 3),
    ("a", "2005-05-05", "2004-01-01", 4), ("a", None, "2010-01-01", 5), ("b", "2150-01-01", "2199-12-31", 6),
    (None, "2000-01-01", None, 7), ("a", "2000-01-01", None, 1), ("b", "1999-12-31", "2001-01-01", 8),
]


@pytest.mark.parametrize("bin_days", [1, 30, 366, 100000])
def test_active_in_bins_equals_plain_join(make, bin_days):
    days = ["1849-12-31", "1850-06-01", "1903-03-03", "2000-01-01", "2000-01-02", "2004-06-01", "2160-01-01", "2262-04-11", None]
    asked = make("id string, day date, _bin int", *[(i, d, 1) for i in ("a", "b", "c", None) for d in days], ("a", "2000-01-01", 1))
    spans = make(SPANS, *SPAN_ROWS)
    got = N.join_active_binned(asked, spans, "id", "day", "start", "stop", bin_days=bin_days)
    expected = I.join_active(asked, spans, "id", "day", "start", "stop")
    assert got.columns == expected.columns and rows_of(got) == rows_of(expected) and got.count() > 10


@pytest.mark.parametrize("bin_days", [7, 366])
def test_overlaps_in_bins_report_each_pair_once(make, bin_days):
    a = make(SPANS, *SPAN_ROWS)
    b = make(SPANS, *SPAN_ROWS, ("a", "1890-01-01", "2300-01-01", 9)).toDF("id_b", "start_b", "stop_b", "tag_b")
    got = N.overlap_join_binned(a, b, on="id", right_on="id_b", left_span=("start", "stop"),
                                right_span=("start_b", "stop_b"), bin_days=bin_days)
    end = "9999-12-31"
    fits = lambda r: r[0] is not None and r[1] is not None and r[1] <= (r[2] or end)
    expected = sorted(
        (x[3], y[3]) for x in SPAN_ROWS for y in [*SPAN_ROWS, ("a", "1890-01-01", "2300-01-01", 9)]
        if fits(x) and fits(y) and x[0] == y[0] and x[1] <= (y[2] or end) and y[1] <= (x[2] or end)
    )
    assert sorted(tuple(r) for r in got.select("tag", "tag_b").collect()) == expected
    with pytest.raises(ValueError):
        N.overlap_join_binned(a, a, on="id", right_on="id", left_span=("start", "stop"), right_span=("start", "stop"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(values, depth):
    ranges = {}
    for v in set(values):
        item = "n" if v is None else "v" + v
        ranges.setdefault(sha(item)[:depth], []).append((item, values.count(v)))
    nodes = {k: (sum(c for _, c in v), sha("|".join(sorted(f"{i}:{c}" for i, c in v)))) for k, v in ranges.items()}
    out = {(depth, k): v for k, v in nodes.items()}
    for level in range(depth - 1, -1, -1):
        parents = {}
        for k, v in nodes.items():
            parents.setdefault(k[:level], []).append((k, v))
        nodes = {p: (sum(v[0] for _, v in c), sha("|".join(sorted(f"{k}:{v[1]}" for k, v in c)))) for p, c in parents.items()}
        out |= {(level, k): v for k, v in nodes.items()}
    return out


def test_hash_tree_equals_plain_tree_and_finds_the_differences(spark):
    values = [f"run{i}" for i in range(300)] + ["run1", "", None, None, "n", "v"]
    changed = [v for v in values if v != "run7"] + ["run1", "new", None]
    ours, theirs = (spark.createDataFrame([(v,) for v in side], "repro_hash string") for side in (values, changed))
    tree, other = H.hash_tree(ours, depth=2), H.hash_tree(theirs.repartition(5), depth=2)
    assert {(r["level"], r["node"]): (r["rows"], r["hash"]) for r in tree.collect()} == plain_tree(values, 2)
    differ = H.differing_ranges(tree, other).collect()
    wanted = {sha(x)[:2] for x in ("vrun7", "vrun1", "vnew", "n")}
    assert {r["node"] for r in differ if r["level"] == 2} == wanted and ("" in {r["node"] for r in differ})
    got = {(r["repro_hash"], r["our_copies"], r["their_copies"]) for r in H.differing_values(ours, theirs, depth=2).collect()}
    assert got == {("run7", 1, 0), ("run1", 2, 3), ("new", 0, 1), (None, 2, 3)}
    assert H.differing_ranges(tree, tree).count() == 0 and H.hash_tree(ours.where("false")).count() == 0
