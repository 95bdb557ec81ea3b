"""Leaf-wise boosting against a plain leaf-wise tree, on rows in memory and on tables."""

import numpy as np
import pytest

from factorloom.operators import boosting as W


def plain_leaves(x, y, leaves, least):
    """Row sets of a best-first tree over exact values; the best cut of a leaf is searched anew each time."""
    def cut(rows):
        best = (0.0, None)
        for j in range(x.shape[1]):
            for low in np.unique(x[rows, j])[:-1]:
                left = x[rows, j] <= low
                if min(left.sum(), (~left).sum()) >= least:
                    error = lambda m: ((y[rows][m] - y[rows][m].mean()) ** 2).sum()
                    gain = error(np.ones(len(rows), bool)) - error(left) - error(~left)
                    if gain > best[0] * (1 + 1e-9) + 1e-12:
                        best = (gain, (rows[left], rows[~left]))
        return best

    found = [np.arange(len(y))]
    while len(found) < leaves:
        gain, at, parts = max(((*cut(rows)[:1], k, cut(rows)[1]) for k, rows in enumerate(found)), key=lambda c: c[0])
        if not gain:
            break
        found[at: at + 1] = parts
    return found


def some_rows(count, seed):
    g = np.random.default_rng(seed)
    x = np.column_stack([g.integers(0, 12, count), g.normal(size=count).round(1), g.integers(0, 3, count)]).astype(float)
    return x, np.where(x[:, 0] > 5, 1.0, 0.0) + 0.5 * x[:, 1] * (x[:, 2] == 1) + g.normal(0, 0.1, count)


@pytest.mark.parametrize(("leaves", "least"), [(2, 1), (6, 5), (31, 3)])
def test_first_tree_equals_a_plain_leaf_wise_tree(leaves, least):
    x, y = some_rows(150, leaves)
    model = W.fit_rows(x, y, W.Settings(trees=1, rate=1.0, leaves=leaves, min_leaf=least, feature_share=1.0))
    bins = model.binned(x)
    got = sorted(tuple(np.flatnonzero(W.on_path(bins, path))) for path, _ in model.trees[0])
    assert got == sorted(map(tuple, plain_leaves(x, y - y.mean(), leaves, least)))
    for path, value in model.trees[0]:
        assert value == pytest.approx((y - y.mean())[W.on_path(bins, path)].mean())


def test_growth_is_best_first_not_level_first():
    """One side is cut again and again while the other, nearly even, is left alone."""
    x = np.arange(80.0)[:, None]
    y = np.where(x[:, 0] < 40, 0.001 * (x[:, 0] >= 20), np.floor(x[:, 0] / 5))
    model = W.fit_rows(x, y, W.Settings(trees=1, leaves=8, min_leaf=1, feature_share=1.0))
    assert sorted(len(path) for path, _ in model.trees[0])[0] == 1 and max(len(p) for p, _ in model.trees[0]) >= 4


def test_boosting_lowers_the_error_and_handles_gaps():
    x, y = some_rows(400, 3)
    x[::7, 1] = np.nan
    errors = [np.mean((W.fit_rows(x, y, W.Settings(trees=n)).predict(x) - y) ** 2) for n in (0, 5, 60)]
    assert errors[0] == pytest.approx(y.var()) and errors[0] > errors[1] > errors[2]
    none = W.fit_rows(np.full((30, 2), np.nan), y[:30])
    assert np.allclose(none.predict(x[:, :2]), y[:30].mean())


def test_table_fit_equals_the_fit_in_memory(spark):
    x, y = some_rows(500, 4)
    x[::9, 0] = np.nan
    rows = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double").repartition(3)
    settings = W.Settings(trees=4, leaves=7, feature_share=0.7)
    one, two = W.fit_rows(x, y, settings), W.fit_panel(rows, ["a", "b", "c"], "y", settings, restage=2)
    got = W.predict_panel(rows, two, ["a", "b", "c"]).toPandas()
    np.testing.assert_allclose(got["prediction"], one.predict(got[["a", "b", "c"]].to_numpy()), atol=1e-9)
    assert [sorted(len(p) for p, _ in t) for t in two.trees] == [sorted(len(p) for p, _ in t) for t in one.trees]
    assert two.cuts().sum() == sum(len(t) - 1 for t in two.trees)
    with pytest.raises(ValueError):
        W.fit_panel(rows.limit(0), ["a"], "y")
