import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import metrics as M
from factorloom.operators import models as L
from factorloom.plans.staging import stage
from tests.conftest import rows_of

PRED = "split string, period date, id long, actual double, prediction double"


def random_predictions(seed=0, periods=7, ids=23):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(periods):
        for i in range(ids if t != 3 else 1):
            rows.append(("x", dt.date(2019 + t // 4, 3 * (t % 4) + 1, 1), i, round(rng.normal(), 1), round(rng.normal(), 1)))
    pdf = pd.DataFrame(rows, columns=["split", "period", "id", "actual", "prediction"])
    pdf.loc[pdf.period == pdf.period.max(), "prediction"] = 0.5  # a constant period
    return pdf


def naive(pdf):
    ics, pears, spreads, turns, before = {}, [], [], [], None
    for period, g in pdf.groupby("period"):
        if len(g) >= 2 and g.actual.nunique() > 1 and g.prediction.nunique() > 1:
            ics[period] = g.prediction.rank().corr(g.actual.rank())
            pears.append(g.prediction.corr(g.actual))
        g = g.sort_values(["prediction", "id"])
        k = int(np.ceil(len(g) * 0.1))
        if len(g) >= 2:
            spreads.append(g.actual.tail(k).mean() - g.actual.head(k).mean())
        top = set(g.id.tail(k))
        if before is not None:
            turns.append(len(top ^ before) / len(top | before))
        before = top
    equity = (1 + pd.Series(spreads)).cumprod()
    signed = pdf[(pdf.actual != 0) & (pdf.prediction != 0)]
    ic = pd.Series(ics)
    yearly = ic.groupby(lambda d: d.year).mean()
    return {
        "rank_ic": ic.mean(), "pearson_ic": np.mean(pears), "decile_long_short_return": np.mean(spreads),
        "hit_rate": (np.sign(signed.actual) == np.sign(signed.prediction)).mean(), "mse": ((pdf.actual - pdf.prediction) ** 2).mean(),
        "mae": (pdf.actual - pdf.prediction).abs().mean(), "turnover_proxy": np.mean(turns),
        "max_drawdown": (equity / equity.cummax() - 1).min(), "ic_std": ic.std(ddof=0), "positive_ic_share": (ic > 0).mean(),
        "yearly_ic_std": yearly.std(ddof=0), "row_count": len(pdf), "period_count": pdf.period.nunique(),
    }


def test_all_metrics_equal_pandas(spark):
    pdf = random_predictions()
    got = M.evaluate_predictions(spark.createDataFrame(pdf)).first().asDict()
    for name, value in naive(pdf).items():
        assert got[name] == pytest.approx(value), name
    assert got["feature_coverage"] is None


def test_symmetric_periods_have_no_rank_correlation(make):
    rows = [("x", d, i, a, p) for d, acts in (("2020-01-31", (0.1, 0.2, 0.3)), ("2020-02-29", (0.3, 0.2, 0.1)))
            for i, (a, p) in enumerate(zip(acts, (1.0, 2.0, 3.0)))]
    ic = M.period_ic(make(PRED, *rows))
    assert sorted(r.rank_ic for r in ic.collect()) == pytest.approx([-1.0, 1.0])


def test_turnover_of_one_name_each(make):
    rows = [("x", d, i + 1, 0.0, p) for d, ps in (("2020-01-31", (0.1, 0.9, 0.2)), ("2020-02-29", (0.8, 0.1, 0.2))) for i, p in enumerate(ps)]
    assert rows_of(M.top_turnover_by_period(make(PRED, *rows), fraction=1 / 3), "turnover") == [(1.0,)]


def test_missing_values_and_coverage(make):
    rows = make(PRED + ", f double", ("x", "2020-01-31", 1, None, 0.5, 1.0), ("x", "2020-01-31", 2, 0.1, None, None), ("x", "2020-01-31", 3, 0.1, 0.2, 2.0))
    errors = M.pair_errors(rows).first()
    assert (errors.row_count, errors.hit_rate) == (1, 1.0) and errors.mae == pytest.approx(0.1)
    assert M.feature_coverage(rows, ["f", "id"]).first().feature_coverage == pytest.approx((2 / 3 + 1) / 2)


def test_validation_alone_selects(make):
    rows = make("model string, split string, rank_ic double", ("first", "validation", 0.5), ("first", "holdout", -1.0),
                ("second", "validation", 0.1), ("second", "holdout", 1.0), ("third", "validation", None))
    assert M.select_by_validation(rows).first().model == "first"
    assert M.select_by_validation(rows, higher_is_better=False).first().model == "second"


# --- splits ----------------------------------------------------------------------------

def dates(spark, n):
    return spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(n)], "formation_date date")


@pytest.mark.parametrize("n,v,h", [(6, 0.2, 0.2), (10, 0.25, 0.25), (3, 0.4, 0.4), (30, 0.15, 0.15), (5, 0.5, 0.3)])
def test_chronological_split_sizes(spark, n, v, h):
    holdout, valid = max(1, round(n * h)), max(1, round(n * v))
    valid = max(1, valid - max(0, holdout + valid - (n - 1)))
    got = rows_of(L.chronological_split(dates(spark, n), validation_fraction=v, holdout_fraction=h), order=["formation_date"])
    assert [s for _, s in got] == ["train"] * (n - holdout - valid) + ["validation"] * valid + ["holdout"] * holdout


def test_split_errors(spark):
    for options in ({"validation_fraction": 0.6, "holdout_fraction": 0.5}, {"validation_fraction": 0.0}, {"holdout_fraction": 1.0},
                    {"min_train_periods": 0}):
        with pytest.raises(ValueError):
            L.chronological_split(dates(spark, 10), **options)
    with pytest.raises(ValueError):
        L.chronological_split(dates(spark, 2))


# --- fits ------------------------------------------------------------------------------

def closed_form(x, y, new, alpha):
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1.0)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + (new - mean) / std @ w


def test_ridge_fit_with_gaps_constant_and_empty_columns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=40)
    np.testing.assert_allclose(L.ridge_fit(2.0)(x, y, x), closed_form(x, y, x, 2.0))
    messy = np.column_stack([x, np.full(40, 3.0), np.full(40, np.nan)])
    np.testing.assert_allclose(L.ridge_fit(2.0)(messy, y, messy), closed_form(x, y, x, 2.0))
    gaps = x.copy()
    gaps[::4, 1] = np.nan
    filled = np.where(np.isnan(gaps), np.nanmedian(gaps, axis=0), gaps)
    np.testing.assert_allclose(L.ridge_fit(1.0)(gaps, y, gaps), closed_form(filled, y, filled, 1.0))


def test_elastic_net_fit_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = x @ [1.0, 0.0, -0.3, 0.0] + rng.normal(size=60) * 0.1
    z = (x - x.mean(0)) / x.std(0)
    alpha, share = 0.2, 0.5
    fitted = L.elastic_net_fit(alpha, share)(x, y, x)
    w = np.linalg.lstsq(z, fitted - y.mean(), rcond=None)[0]
    grad = z.T @ (y - y.mean() - z @ w) / 60 - alpha * (1 - share) * w
    zero = np.abs(w) < 1e-8
    np.testing.assert_allclose(grad[~zero], alpha * share * np.sign(w[~zero]), atol=1e-7)
    assert (np.abs(grad[zero]) <= alpha * share + 1e-7).all()


def panel_frame(spark, n_periods=10, n_ids=30):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(n_periods):
        for i in range(n_ids):
            a, b = rng.normal(), rng.normal()
            rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=31 * t), a, None if (i + t) % 5 == 0 else b, None, 4.0,
                         0.05 * a - 0.02 * b + rng.normal() * 0.01))
    return spark.createDataFrame(rows, "permno long, formation_date date, a double, b double, none double, same double, ret_1m_fwd double")


def panel_arrays(df):
    pdf = df.toPandas().sort_values(["formation_date", "permno"])
    train = pdf.formation_date < sorted(pdf.formation_date.unique())[6]
    x = pdf[["a", "b"]].astype(float)
    x = x.fillna(x[train].median()).to_numpy()
    return pdf, train.to_numpy(), x, pdf.ret_1m_fwd.to_numpy()


@pytest.mark.parametrize("model", ["ridge", "elasticnet"])
def test_panel_models_equal_direct_solutions(spark, model):
    df = stage(panel_frame(spark), "frame")
    out = L.evaluate_panel_model(df, model=model)
    pdf, train, x, y = panel_arrays(df)
    if model == "ridge":
        want = closed_form(x[train], y[train], x, 1.0)
    else:
        want = L.elastic_net_fit()(x[train], y[train], x)
    got = {(r.permno, r.formation_date): r.prediction for r in out.predictions.collect()}
    np.testing.assert_allclose([got[k] for k in zip(pdf.permno, pdf.formation_date)], want, atol=1e-6)
    assert {r.split for r in out.metrics.collect()} == {"train", "validation", "holdout"}
    importance = {r.feature: r.importance for r in out.importance.collect()}
    assert importance["a"] > importance["b"] > 0 and importance["none"] is None and importance["same"] == pytest.approx(0)


def test_panel_baselines_and_forest(spark):
    df = stage(panel_frame(spark, 6, 40), "frame")
    mean = L.evaluate_panel_model(df, model="baseline_mean", validation_fraction=0.2, holdout_fraction=0.2)
    train = df.join(mean.splits.where("split = 'train'"), "formation_date").agg(F.avg("ret_1m_fwd")).first()[0]
    assert {round(r.prediction, 9) for r in mean.predictions.collect()} == {round(train, 9)}
    assert {r.importance_type for r in mean.importance.collect()} == {"unavailable"}
    forest = L.evaluate_panel_model(df, model="random_forest", params={"numTrees": 5})
    assert forest.predictions.count() == 240 and forest.metrics.where("split = 'train'").first().rank_ic > 0.5
    with pytest.raises(KeyError):
        L.evaluate_panel_model(df, model="other")


def test_feature_columns_of_the_matrix(spark):
    df = panel_frame(spark, 1, 1).withColumn("label", F.lit("x"))
    assert L.numeric_features(df, "ret_1m_fwd") == ["a", "b", "none", "same"]
    with pytest.raises(ValueError):
        L.numeric_features(df.select("permno", "label", "ret_1m_fwd"), "ret_1m_fwd")


def test_random_scores_repeat_and_look_normal(spark):
    df = spark.range(4000).select("id", L.random_score("id").alias("z"), L.random_score("id").alias("again"))
    row = df.agg(F.avg("z"), F.stddev("z"), F.count_if(F.col("z") != F.col("again"))).first()
    assert abs(row[0]) < 0.06 and abs(row[1] - 1) < 0.05 and row[2] == 0


def test_period_runs(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate("aaabbc")], "n int, p string")
    assert rows_of(L.period_runs(rows, order="n", period="p"), "run", "size") == [(1, 3), (2, 2), (3, 1)]
    broken = spark.createDataFrame([(i, p) for i, p in enumerate("aabba")], "n int, p string")
    with pytest.raises(ValueError, match="contiguous"):
        L.period_runs(broken, order="n", period="p")
