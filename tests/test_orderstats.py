import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import scalars as S
from factorloom.plans.orderstats import (
    coarse_cell, distinct_value_ranks, fine_cell, grouped_quantiles, ordinal_ranks, pick_ranked, wide_cell,
)


def values(spark, seed=0):
    """Three groups: smooth values, one value in a third of all rows, and a narrow band."""
    rng = np.random.default_rng(seed)
    smooth = rng.normal(size=400)
    hot = np.where(rng.random(600) < 0.6, 0.25, rng.normal(size=600))
    narrow = 100 + rng.random(300) * 1e-9
    wide = np.concatenate([[-1e300, -1e-300, 0.0, -0.0, 1e-300, 1e300, 5e-324], rng.normal(size=40) * 1e10])
    pdf = pd.concat([
        pd.DataFrame({"g": name, "v": v}) for name, v in (("a", smooth), ("b", hot), ("c", narrow), ("d", wide))
    ], ignore_index=True)
    pdf["id"] = rng.permutation(len(pdf)).astype("int64")
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_equal_pandas(spark):
    pdf, df = values(spark)
    got = grouped_quantiles(df, ["g"], "v", {"lo": 0.2, "hi": 0.8, "top": 0.9}).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.2, 0.8, 0.9]).unstack()
    for name, q in (("lo", 0.2), ("hi", 0.8), ("top", 0.9)):
        np.testing.assert_allclose(got[name].sort_index(), want[q].sort_index(), rtol=1e-12)
    assert got["group_rows"].to_dict() == pdf.groupby("g").size().to_dict()


def test_average_ranks_equal_pandas(spark):
    pdf, df = values(spark, 1)
    pdf["rank"] = pdf.groupby("g")["v"].rank()
    got = distinct_value_ranks(df, ["g"], "v").toPandas()
    joined = pdf.merge(got, on=["g", "v"])
    assert len(joined) == len(pdf)
    np.testing.assert_array_equal(joined["rank"], joined["average_rank"])


def test_ranked_pick_with_tie_column(spark):
    pdf, df = values(spark, 2)
    pdf["v"] = pdf["v"] + 0.0  # -0.0 and 0.0 are one value
    got = pick_ranked(df, ["g"], "v", {"p": lambda n: F.floor(n * 0.5), "first": lambda n: F.lit(0), "no": lambda n: n},
                      tie="id").toPandas()
    assert set(got["pick"]) == {"p", "first"}
    for g, part in pdf.groupby("g"):
        ordered = part.sort_values(["v", "id"]).reset_index(drop=True)
        for name, place in (("p", len(part) // 2), ("first", 0)):
            row = got[(got.g == g) & (got.pick == name)].iloc[0]
            assert (row["value"], row["tie"]) == (ordered["v"][place], ordered["id"][place])


def test_ordinal_ranks_break_ties_by_id(spark):
    pdf, df = values(spark, 3)
    got = ordinal_ranks(df, ["g"], "v", "id", "r").toPandas()
    want = pdf.assign(v=pdf.v + 0.0).sort_values(["g", "v", "id"])
    want["r"] = want.groupby("g").cumcount() + 1
    joined = got.merge(want, on=["g", "id"])
    assert len(joined) == len(pdf) and (joined["r_x"] == joined["r_y"]).all()


def test_large_ids_stay_exact(spark):
    base = 1 << 60
    rows = [("a", 1.0, base + k) for k in (2, 0, 1)] + [("a", 2.0, base + 3)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    got = ordinal_ranks(df, ["g"], "v", "id", "r").orderBy("id").collect()
    assert [r.r for r in got] == [1, 2, 3, 4]
    picked = pick_ranked(df, ["g"], "id", {"second": lambda n: F.lit(1)}).first()
    assert picked["value"] == base + 1
    tied = pick_ranked(df, ["g"], "v", {"third": lambda n: F.lit(2)}, tie="id").first()
    assert (tied["value"], tied["tie"]) == (1.0, base + 2)


def test_non_finite_values_are_left_out(spark):
    df = spark.createDataFrame([("a", v) for v in (float("inf"), float("-inf"), float("nan"), None, 2.0, 1.0)], "g string, v double")
    got = distinct_value_ranks(df, ["g"], "v").orderBy("v").collect()
    assert [(r.v, r.rows_below, r.rows_equal) for r in got] == [(1.0, 0, 1), (2.0, 1, 1)]
    assert grouped_quantiles(df, ["g"], "v", {"m": 0.5}).first()["m"] == 1.5


def test_text_has_no_order_statistic(spark):
    with pytest.raises(TypeError):
        pick_ranked(spark.createDataFrame([("a", "x")], "g string, v string"), ["g"], "v", {"p": lambda n: F.lit(0)})


def test_large_numbers_keep_their_value_when_rounded(spark):
    got = spark.sql("SELECT 5e7D AS a, -1.23456789e16D AS b, 0.1234567D AS c").select(S.fixed_point("a", 12), S.fixed_point("b"), S.fixed_point("c")).first()
    assert tuple(got) == (5e7, -1.23456789e16, 0.123457)


def test_cells_keep_the_order(spark):
    _, df = values(spark, 4)
    rows = df.select("v", coarse_cell(F.col("v")).alias("c"), fine_cell(F.col("v")).alias("f")).orderBy("v").collect()
    keys = [(r.c, r.f) for r in rows]
    assert keys == sorted(keys)


def test_text_and_number_helpers(spark):
    df = spark.sql("SELECT ' ab\t' AS t, 'x1' AS bad, '12' AS code, '1234567' AS long, '2020-13-01' AS d, 0D AS z")
    row = df.select(
        S.normalized_text("t").alias("t"), S.as_number("bad").alias("bad"), S.zero_padded("code").alias("code"),
        S.zero_padded("long").alias("long"), S.as_date(df, "d").alias("d"), S.safe_divide(F.lit(1.0), F.col("z")).alias("q"),
        S.clipped(F.lit(None).cast("double"), -5.0, 5.0).alias("c"), S.clipped(F.lit(9.0), -5.0, 5.0).alias("c9"),
    ).first()
    assert tuple(row) == ("AB", None, "000012", "1234567", None, None, None, 5.0)


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 7.0, 7.0), (None, 1.0, 7.0)], "x double, y double, k double")
    got = df.agg(S.guarded_correlation(F.col("x"), F.col("y")).alias("r"), S.guarded_correlation(F.col("x"), F.col("k")).alias("k")).first()
    assert got["r"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1]) and got["k"] is None


def test_nan_and_infinity_become_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (1.5, 3)], "x double, n int")
    assert [r.x for r in S.nulled_nonfinite(df).orderBy("n").collect()] == [None, None, 1.5]


def test_first_cells_are_few_and_nested(spark):
    rows = spark.createDataFrame(pd.DataFrame({"v": np.random.default_rng(5).normal(size=20_000)}))
    cells = rows.select("v", wide_cell(F.col("v")).alias("wide"), coarse_cell(F.col("v")).alias("coarse")).toPandas().sort_values("v")
    assert cells["wide"].is_monotonic_increasing
    assert cells.groupby("coarse")["wide"].nunique().max() == 1
    # a task's rows of a group become far fewer counts before they are shuffled
    assert cells["wide"].nunique() < 300 < 2000 < cells["coarse"].nunique()
