"""Every registered query at the smallest scale: against its SQL where there is one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as contract
from factorloom.catalog.queries import REGISTERED

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
ORACLE = contract.oracle_sql()
OWN = sorted(set(ORACLE) & set(REGISTERED))
# minutes of model fitting; the fits themselves are tested elsewhere
SLOW = {"panel_boosting_eval", "panel_forest_eval", "panel_elastic_net_eval", "panel_ridge_eval", "feature_importance"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def normal(row):
    return tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


def test_names_match():
    assert set(ORACLE) <= set(contract.queries())
    assert set(REGISTERED) - set(ORACLE) == {"ridge_factor_forecast", "elastic_net_factor_forecast"} | SLOW


def test_entry_gives_rows(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "factor_long_short_ret_1m" in df.columns


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(normal(r[c] for c in columns) for r in df.collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(normal(r[i] for i in places) for r in result.fetchall())
