import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import factors as G
from factorloom.operators import models as L
from factorloom.operators import folds as FD
from factorloom.operators import trees as TR
from factorloom.operators import portfolio as B
from factorloom.plans.staging import stage
from tests.conftest import rows_of

COLUMNS = ["compustat__pb", "compustat__pe_proxy", "compustat__debt_to_assets", "compustat__revenue_yoy", "compustat__net_income_yoy",
           "ibes__revision_1m", "ibes__surprise", "ibes__estimate_dispersion", "ibes__target_price_mean",
           "ibes__target_revision_balance_1m", "crsp__mom_12_2", "crsp__mom_6_2", "crsp__reversal_1m", "crsp__log_size"]


def synthetic(months, assets, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(months):
        for p in range(assets):
            row = {"formation_date": (pd.Timestamp("2018-01-31") + pd.offsets.MonthEnd(m)).date(), "permno": p,
                   "exchcd": 1 if p < assets // 2 else 2, "ret_1m_fwd": 0.002 * p - 0.001 * m + rng.normal(0, 0.01)}
            row |= {c: float(p + 0.1 * m + rng.normal()) for c in COLUMNS}
            row |= {"macro__a": float(m), "macro__b": float(m % 3)}
            rows.append(row)
    return pd.DataFrame(rows)


def factor(name, column, sign=1.0, scope="global"):
    return G.Factor(name, name, column, sign, "implemented", "test", scope)


def zscore(values):
    std = values.std()
    return pd.Series(np.nan, values.index) if not std > 1e-12 else ((values - values.mean()) / std).clip(-5, 5)


def naive_returns(scores, q):
    out = {}
    for (day, name), g in scores.dropna().groupby(["formation_date", "factor_id"]):
        if len(g) < 10:
            out[day, name] = (None, 0, 0)
            continue
        top, low = g.factor_score.quantile(1 - q), g.factor_score.quantile(q)
        a, b = g.ret_1m_fwd[g.factor_score >= top], g.ret_1m_fwd[g.factor_score <= low]
        out[day, name] = (a.mean() - b.mean(), len(a), len(b))
    return out


def test_registry_counts():
    assert (len(G.FACTORS), len(G.COMPUTABLE), len({f.factor_id for f in G.FACTORS})) == (55, 54, 55)
    families = pd.Series([f.family for f in G.FACTORS]).value_counts().to_dict()
    assert families == {"valuation": 10, "earnings": 33, "quality_growth": 4, "price_momentum": 2, "reversal": 4, "size_flow": 2}


def test_scores_and_returns_equal_pandas(spark):
    pdf = synthetic(4, 30)
    pdf.loc[pdf.permno == 3, "compustat__pb"] = np.nan
    pdf.loc[pdf.permno == 4, "ret_1m_fwd"] = np.nan
    pdf.loc[pdf.formation_date == pdf.formation_date.min(), "crsp__mom_6_2"] = 1.0  # constant: no score
    df = spark.createDataFrame(pdf).select([F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c)
                                            for c, t in spark.createDataFrame(pdf).dtypes])
    chosen = [factor("value", "compustat__pb", -1.0, "local"), factor("growth", "compustat__revenue_yoy"),
              factor("mom", "crsp__mom_6_2", 1.0, "local"), factor("absent", "ibes__none")]
    got = G.factor_scores(df, chosen, float32_scores=False).toPandas()
    parts = []
    for f in chosen[:3]:
        keys = ["formation_date", "exchcd"] if f.scope == "local" else ["formation_date"]
        part = pdf[["formation_date", "permno", "ret_1m_fwd"]].copy()
        part["factor_id"] = f.factor_id
        part["factor_score"] = pdf.groupby(keys)[f.source_column].transform(zscore) * f.direction
        parts.append(part.dropna(subset=["factor_score"]))
    want = pd.concat(parts)
    joined = got.merge(want, on=["formation_date", "permno", "factor_id"])
    assert len(joined) == len(got) == len(want)
    np.testing.assert_allclose(joined.factor_score_x, joined.factor_score_y, rtol=1e-9, atol=1e-12)

    naive = naive_returns(want, 0.2)
    for result in (G.panel_factor_returns(df, chosen, quantiles=(0.2,)), G.long_short_returns(G.factor_scores(df, chosen), df, quantile=0.2)):
        rows = result.collect()
        assert {(r.formation_date, r.factor_id) for r in rows} == set(naive)
        for r in rows:
            mean, top, low = naive[r.formation_date, r.factor_id]
            assert (r.long_count, r.short_count) == (top, low)
            assert r.factor_long_short_ret_1m == pytest.approx(mean, rel=1e-6)


def test_small_cross_sections_have_no_return(spark):
    df = spark.createDataFrame(synthetic(2, 9))
    rows = G.panel_factor_returns(df, [factor("x", "compustat__pb")]).collect()
    assert [(r.long_return, r.long_count, r.short_count) for r in rows] == [(None, 0, 0)] * 2


def test_one_date_may_hold_most_rows_and_ties(spark):
    """A third of a date shares one score; cuts must keep all of the ties."""
    pdf = synthetic(1, 90)
    pdf["compustat__pb"] = np.where(pdf.permno % 3 == 0, 50.0, pdf["compustat__pb"])
    got = G.panel_factor_returns(spark.createDataFrame(pdf), [factor("x", "compustat__pb")], quantiles=(0.1, 0.3)).collect()
    pdf["factor_score"] = zscore(pdf["compustat__pb"]).astype("float32").astype(float)
    pdf["factor_id"] = "x"
    for r in got:
        mean, top, low = naive_returns(pdf[["formation_date", "factor_id", "factor_score", "ret_1m_fwd"]], r.quantile)[r.formation_date, "x"]
        assert (r.long_count, r.short_count) == (top, low) and r.factor_long_short_ret_1m == pytest.approx(mean)


def test_quantile_limits_and_row_guard(spark):
    df = spark.createDataFrame(synthetic(1, 12))
    for q in (0.0, 0.5):
        with pytest.raises(ValueError):
            G.long_short_returns(G.factor_scores(df), df, quantile=q)
    assert G.score_row_estimate(df) == 12 * 54
    with pytest.raises(ValueError, match="exceed"):
        G.score_row_estimate(df, limit=100)


@pytest.fixture(scope="module")
def research(spark):
    df = stage(spark.createDataFrame(synthetic(40, 24)), "synthetic")
    return df, stage(G.panel_factor_returns(df), "returns"), stage(G.macro_design(df), "macro")


def test_alpha_scores_equal_pandas(research):
    _, returns, macro = research
    pdf, m = returns.toPandas(), macro.toPandas()
    stats = pdf.groupby("factor_id").factor_long_short_ret_1m.agg(["mean", lambda v: v.std(ddof=0)])
    want_global = (stats.iloc[:, 0] / stats.iloc[:, 1]).clip(lower=0)
    best = {}
    joined = pdf.merge(m, on="formation_date")
    for c in ("macro__a", "macro__b"):
        state = np.where(joined[c] >= m[c].median(), "high", "low")
        for name, value in joined.groupby(["factor_id", state]).factor_long_short_ret_1m.mean().items():
            best[name[0]] = max(best.get(name[0], 0.0), value)
    table = {r.factor_id: r for r in G.alpha_table(returns, macro).collect()}
    want = pd.DataFrame({"g": want_global, "l": pd.Series(best)}).round(12)
    combined = want.g.rank(pct=True) + want.l.rank(pct=True)
    assert len(table) == 54
    for name, r in table.items():
        assert r.global_score == pytest.approx(want.g[name]) and r.local_score == pytest.approx(want.l[name])
        assert r.combined_score == pytest.approx(combined[name])


def test_equal_sums_of_ranks_tie(make):
    # of 10 rows, 6/10 + 2/10 and 7/10 + 1/10 differ in doubles
    second = [5, 3, 4, 6, 7, 2, 1, 8, 9, 10]
    rows = make("name string, a double, b double", *[(f"f{n}", float(n), float(m)) for n, m in enumerate(second, start=1)])
    ranks = {r["name"]: r["rank"] for r in rows.withColumn("rank", G.percentile_rank("a", "b")).collect()}
    assert ranks["f6"] == ranks["f7"] == 0.8 and ranks["f2"] == 0.5


def test_universe_selection(research):
    _, returns, macro = research
    chosen = G.select_universe(returns, macro, universe="selected_13_global_local").orderBy("selection_rank").collect()
    assert [r.selection_rank for r in chosen] == list(range(1, 14)) and len({r.factor_id for r in chosen}) == 13
    seeds = ["size_local_small_size", "unknown", "val_global_pc_ttm"]
    seeded = G.select_universe(returns, macro, universe="selected_13_plus_us_overrides", overrides=seeds).orderBy("selection_rank").collect()
    assert [r.factor_id for r in seeded[:2]] == [seeds[0], seeds[2]] and len(seeded) == 13
    assert [r.selection_reason for r in seeded[:3]] == ["us_override_seed"] * 2 + ["global_local_alpha"]
    assert G.select_universe(returns, macro).count() == 54
    with pytest.raises(ValueError):
        G.select_universe(returns, macro, universe="other")


def test_macro_designs(research):
    df, _, _ = research
    used, missing = G.macro_columns(["macro__sp500", "macro__sp500_c20", "x"], "us_macro_25x3")
    assert used == ["macro__sp500", "macro__sp500_c20"] and len(missing) == 73
    assert len(G.macro_columns([], "us_macro_expanded")[1]) == 156
    with pytest.raises(ValueError):
        G.macro_design(df.drop("macro__a", "macro__b"))
    constant = G.macro_design(df).withColumns({"macro__a": F.lit(1.0), "macro__b": F.lit(2.0)})
    assert G.macro_states(constant).count() == 0


def test_parameter_grid(spark):
    grid = G.parameter_grid(spark)
    assert grid.count() == grid.drop("variant").distinct().count() == 4 * 4 * 3 * 2 * 3 * 2
    first = rows_of(G.parameter_grid(spark, {"a": ("1", "2"), "b": ("x", "y", "z")}, limit=4), order=["variant"])
    assert first == [(1, "1", "x"), (2, "1", "y"), (3, "1", "z"), (4, "2", "x")]


# --- models on factor returns ----------------------------------------------------------

def naive_folds(dates, least, ahead, step):
    for start in range(least + ahead, len(dates), step):
        valid = max(least, start - ahead)
        yield dates[:valid], dates[valid:start], dates[start:start + step]


def test_walk_forward_folds_equal_the_loop(research):
    _, returns, _ = research
    one = returns.where("factor_id = 'val_global_pb_fwd'")
    dates = sorted(r.formation_date for r in one.collect())
    got = L.walk_forward_folds(one, min_observations=10, validation_periods=5, test_periods=7).collect()
    for number, (train, valid, test) in enumerate(naive_folds(dates, 10, 5, 7)):
        for role, want in (("train", train), ("validation", valid), ("holdout", test)):
            assert sorted(r.formation_date for r in got if r.fold == number and r.role == role) == want
    assert max(r.fold for r in got) == len(list(naive_folds(dates, 10, 5, 7))) - 1


@pytest.mark.parametrize("name,fit", [("ridge", L.ridge_fit()), ("elasticnet", L.elastic_net_fit())])
def test_factor_models_fit_each_fold_alone(research, name, fit):
    _, returns, macro = research
    out = L.train_factor_models(returns, macro, model=name, min_observations=12, walk_forward_test_periods=6, walk_forward_validation_periods=6)
    got = {r.formation_date: r.prediction for r in out.predictions.where("factor_id = 'val_global_pb_fwd'").collect()}
    pdf = returns.where("factor_id = 'val_global_pb_fwd'").join(macro, "formation_date").toPandas().set_index("formation_date").sort_index()
    x, y = pdf[["macro__a", "macro__b"]].to_numpy(), pdf[L.TARGET]
    seen = {}
    for train, _, test in naive_folds(list(pdf.index), 12, 6, 6):
        rows, ask = pdf.index.isin(train), pdf.index.isin(test)
        seen |= dict(zip(pdf.index[ask], fit(x[rows], y[rows].to_numpy(), x[ask])))
    assert set(got) == set(seen)
    assert all(got[d] == pytest.approx(seen[d]) for d in seen)
    metric = out.metrics.where("factor_id = 'val_global_pb_fwd'").first()
    assert metric.fold_count == 4 and metric.holdout_rows == len(seen)
    errors = [abs(seen[d] - y[d]) for d in seen]
    assert metric.holdout_mae == pytest.approx(np.mean(errors))
    want = pd.Series(seen).rank().corr(y[list(seen)].rank())
    assert metric.holdout_correlation == pytest.approx(want)


@pytest.mark.parametrize("name,fit", [("ridge", L.ridge_fit()), ("elasticnet", L.elastic_net_fit(0.0005))])
def test_running_sums_fit_every_fold_like_its_rows(make, name, fit):
    """Gaps, constants at the start, an empty column, a far offset, factors of different length; no fold overlaps another's test."""
    g = np.random.default_rng(5)
    dates = pd.date_range("2000-01-31", periods=60, freq="ME").date
    columns = ["macro__gap", "macro__late", "macro__empty", "macro__far", "macro__still"]
    x = np.column_stack([
        np.where(g.random(60) < 0.3, np.nan, g.normal(size=60)), np.where(np.arange(60) < 40, 3.0, g.normal(size=60)),
        np.full(60, np.nan), 1e6 + g.normal(size=60), np.full(60, 0.1),
    ])
    plain = lambda v: None if np.isnan(v) else float(v)
    macro = make("formation_date date, " + ", ".join(f"{c} double" for c in columns), *[(str(d), *map(plain, v)) for d, v in zip(dates, x)])
    sizes = {"a": 60, "b": 47, "c": 31, "d": 12}
    y = {f: g.normal(0, 0.05, n) for f, n in sizes.items()}
    returns = make(f"formation_date date, factor_id string, {L.TARGET} double", *[(str(dates[k + 60 - n]), f, float(y[f][k])) for f, n in sizes.items() for k in range(n)])
    params = {"alpha": 0.0005} if name == "elasticnet" else {}
    for least, ahead, step in ((12, 6, 5), (20, 0, 12), (15, 9, 4)):
        out = L.train_factor_models(returns, macro, model=name, model_params=params, min_observations=least,
                                    walk_forward_validation_periods=ahead, walk_forward_test_periods=step)
        got = {(r.factor_id, r.formation_date): r.prediction for r in out.predictions.collect()}
        want, train_rows = {}, {}
        for f, n in sizes.items():
            mine = list(dates[60 - n:])
            for train, _, test in naive_folds(mine, least, ahead, step):
                rows, ask = np.isin(dates, train), np.isin(dates, test)
                want |= {(f, d): v for d, v in zip(dates[ask], fit(x[rows], y[f][np.isin(mine, train)], x[ask]))}
                train_rows[f] = train_rows.get(f, 0) + len(train)
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)
        assert {r.factor_id: r.train_rows for r in out.metrics.collect()} == train_rows


def plain_tree(x, y, w, ask, depth, least):
    """Mean of the leaf of each asked row; the cut with the largest fall of squared error, first feature and value of equal ones."""
    best = (0.0, None)
    if depth:
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for low, high in zip(values, values[1:]):
                left = x[:, j] <= low
                if min(left.sum(), (~left).sum()) < least:
                    continue
                error = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()
                gain = round(error(np.ones(len(y), bool)) - error(left) - error(~left), 10)
                if gain > best[0]:
                    best = (gain, (j, (low + high) / 2))
    if best[1] is None:
        return np.full(len(ask), np.average(y, weights=w))
    j, cut = best[1]
    left, out = x[:, j] <= cut, np.empty(len(ask))
    ask_left = ask[:, j] <= cut
    out[ask_left] = plain_tree(x[left], y[left], w[left], ask[ask_left], depth - 1, least)
    out[~ask_left] = plain_tree(x[~left], y[~left], w[~left], ask[~ask_left], depth - 1, least)
    return out


@pytest.mark.parametrize("bootstrap", [False, True])
def test_forests_of_all_folds_equal_plain_trees(make, bootstrap):
    g = np.random.default_rng(8)
    dates = pd.date_range("2001-01-31", periods=48, freq="ME").date
    x = np.column_stack([np.where(g.random(48) < 0.2, np.nan, g.integers(0, 6, 48)), g.normal(size=48), np.full(48, 2.0)])
    plain = lambda v: None if np.isnan(v) else float(v)
    macro = make("formation_date date, macro__a double, macro__b double, macro__c double", *[(str(d), *map(plain, v)) for d, v in zip(dates, x)])
    sizes = {"a": 48, "b": 40}
    y = {f: np.where(np.nan_to_num(x[48 - n:, 0]) > 2, 0.1, -0.1) + g.normal(0, 0.05, n) for f, n in sizes.items()}
    returns = make(f"formation_date date, factor_id string, {L.TARGET} double", *[(str(dates[k + 48 - n]), f, float(y[f][k])) for f, n in sizes.items() for k in range(n)])
    held = FD.fold_rows(returns.join(macro, "formation_date"), list(macro.columns[1:]), L.TARGET, min_observations=18, validation_periods=6, test_periods=7)
    fitted, _ = TR.forest_forecast(held, trees=3, max_depth=4, min_leaf=3, bootstrap=bootstrap)
    got = {(r.factor_id, r.fold, r.formation_date): r.prediction for r in fitted.where("role = 'holdout'").collect()}
    keys = [(f, k, t, d) for f in sizes for k in range(5) for t in range(3) for d in dates]
    drawn = make("factor_id string, fold int, tree int, formation_date date", *[(f, k, t, str(d)) for f, k, t, d in keys])
    times = {tuple(r[:4]): r.w for r in drawn.withColumn("w", TR.drawn_times(42, *TR.UNIT, TR.DATE)).collect()}
    checked = 0
    for f, n in sizes.items():
        mine = list(dates[48 - n:])
        for k, (train, _, test) in enumerate(naive_folds(mine, 18, 6, 7)):
            rows, ask = np.isin(dates, train), np.isin(dates, test)
            fill = np.nanmedian(x[rows], axis=0)
            filled = np.where(np.isnan(x), fill, x)
            trees = []
            for t in range(3):
                w = np.array([times[f, k, t, d] if bootstrap else 1 for d in dates[rows]], float)
                trees.append(plain_tree(filled[rows][w > 0], y[f][np.isin(mine, train)][w > 0], w[w > 0], filled[ask], 4, 3))
            for d, v in zip(dates[ask], np.mean(trees, axis=0)):
                assert got[f, k, d] == pytest.approx(v, abs=1e-9), (f, k, d)
                checked += 1
    assert checked == len(got) > 30


def test_tree_models_by_name(research):
    _, returns, macro = research
    for name in ("random_forest", "extra_trees"):
        out = L.train_factor_models(returns, macro, model=name, min_observations=12, walk_forward_test_periods=6, walk_forward_validation_periods=6,
                                    model_params={"trees": 5, "min_leaf": 2})
        rows = out.predictions.collect()
        assert rows and all(r.split == "holdout" and r.prediction is not None for r in rows)
        assert len({r.prediction for r in rows if r.factor_id == "val_global_pb_fwd"}) > 1
        assert out.metrics.where("train_rows > 0 AND holdout_mae IS NOT NULL").count() == out.metrics.count() > 0


def test_holdout_mode_allocations_and_portfolio(research):
    df, returns, macro = research
    out = L.train_factor_models(returns, macro, model="baseline_mean", evaluation_mode="single_holdout", min_observations=6,
                                validation_fraction=0.2, holdout_fraction=0.2)
    weights = B.factor_allocations(out.predictions)
    sums = weights.groupBy("formation_date", "split").agg(F.sum("weight").alias("s")).collect()
    assert {r.split for r in sums} == {"train", "validation", "holdout"} and all(r.s == pytest.approx(1.0) for r in sums)
    portfolio = B.factor_portfolio(weights, returns)
    for split, part in portfolio.toPandas().sort_values("formation_date").groupby("split"):
        np.testing.assert_allclose(part.cumulative_return, (1 + part.portfolio_return).cumprod() - 1)
    assert B.headline_summary(portfolio).first().periods == 8
    with pytest.raises(ValueError):
        L.train_factor_models(returns, macro, evaluation_mode="other")
    with pytest.raises(KeyError):
        L.train_factor_models(returns, macro, model="other")
    own = L.train_factor_models(returns, macro, model=lambda x, y, new: np.zeros(len(new)))
    assert {r.prediction for r in own.predictions.collect()} == {0.0}


def test_qspread_from_factors_and_from_signals(spark, research):
    df, returns, macro = research
    weights = stage(B.factor_allocations(L.train_factor_models(returns, macro, model="baseline_mean").predictions), "w")
    from_factors = B.stock_scores(weights, G.factor_scores(df))
    from_signals = B.stock_scores_from_signals(weights, G.signal_scores(df), G.registry_frame(spark, G.COMPUTABLE))
    a, b = (d.toPandas().sort_values(["formation_date", "permno"]).reset_index(drop=True) for d in (from_factors, from_signals))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)
    members = stage(B.qspread_members(from_signals, df, leg_quantile=0.2), "m")
    portfolio = B.qspread_portfolio(members).toPandas().sort_values("formation_date")
    before = None
    scored = b.merge(df.select("formation_date", "permno", "ret_1m_fwd").toPandas(), on=["formation_date", "permno"])
    for row in portfolio.itertuples():
        g = scored[scored.formation_date == row.formation_date]
        top = g[g.stock_score >= g.stock_score.quantile(0.8)]
        low = g[g.stock_score <= g.stock_score.quantile(0.2)]
        assert (row.long_count, row.short_count) == (len(top), len(low))
        assert row.portfolio_return == pytest.approx(top.ret_1m_fwd.mean() - low.ret_1m_fwd.mean())
        want = 1.0 if before is None else 1 - len(before & set(top.permno)) / len(top)
        assert row.long_turnover == pytest.approx(want)
        before = set(top.permno)


def test_allocation_rules(make):
    rows = make("formation_date date, factor_id string, prediction double, split string",
                ("2020-01-31", "a", 3.0, "x"), ("2020-01-31", "b", 1.0, "x"), ("2020-01-31", "c", -1.0, "x"),
                ("2020-02-29", "a", -3.0, "x"), ("2020-02-29", "b", None, "x"))
    plain = rows_of(B.factor_allocations(rows), "formation_date", "factor_id", "weight")
    assert [w for _, _, w in plain] == [0.75, 0.25, 0.0, 0.5, 0.5]
    floored = [w for _, _, w in rows_of(B.factor_allocations(rows, min_weight=0.1), "formation_date", "factor_id", "weight")]
    assert floored == pytest.approx([0.75 / 1.1, 0.25 / 1.1, 0.1 / 1.1, 0.5, 0.5])


def test_cumulative_return_restarts_in_each_split(make):
    weights = make("formation_date date, factor_id string, weight double, split string", ("2020-01-31", "f", 1.0, "train"), ("2020-02-29", "f", 1.0, "holdout"))
    returns = make("formation_date date, factor_id string, factor_long_short_ret_1m double", ("2020-01-31", "f", 1.0), ("2020-02-29", "f", 0.1))
    got = {r.split: r.cumulative_return for r in B.factor_portfolio(weights, returns).collect()}
    assert got == pytest.approx({"train": 1.0, "holdout": 0.1})


def test_turnover_by_split_and_across(make):
    legs = make("formation_date date, split string, leg string, permno long", ("2020-01-31", "a", "long", 1), ("2020-01-31", "a", "long", 2),
                ("2020-02-29", "b", "long", 1), ("2020-02-29", "b", "long", 3), ("2020-03-31", "b", "long", 3), ("2020-03-31", "b", "short", 9))
    across = rows_of(B.leg_turnover(legs), "long_turnover", order=["formation_date"])
    alone = rows_of(B.leg_turnover(legs, by_split=True), "long_turnover", order=["formation_date"])
    assert across == [(1.0,), (0.5,), (0.0,)] and alone == [(1.0,), (1.0,), (0.0,)]
