import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factorloom.plans import staging
from factorloom.sources import contracts as C
from factorloom.sources import files as S
from tests.conftest import rows_of


def test_contract_completeness():
    assert len(C.CONTRACTS) == 11
    for c in C.CONTRACTS.values():
        assert set(c.key) <= set(c.required) and set(c.dates) <= set(c.required)
    assert len(C.CONTRACTS["comp_fundq"].required) == 30 and C.CONTRACTS["comp_fundq"].dates == {"datadate": False, "rdq": True}


@pytest.fixture
def raw(spark, make, tmp_path):
    names = make("permno string, comnam string, ncusip string, ticker string, shrcd string, exchcd int, namedt string, nameenddt date",
                 ("1", "a", "x", "t", "10", 1, "2000-01-01", None), ("1", "a", "x", "t", "11", 1, "2000-01-01", None), ("oops", "b", "x", "t", None, 2, "bad", "2001-01-31"))
    names.coalesce(1).write.parquet(str(tmp_path / "crsp_names.parquet"))
    year = tmp_path / "monthly_crsp_msf_by_year"
    schema = "permno long, permco long, date date, prc double, ret double, retx double, shrout double, vol double, cfacpr double, cfacshr double, market_cap double"
    make(schema, (1, 1, "2020-01-31", float("nan"), *[1.0] * 7)).coalesce(1).write.parquet(str(tmp_path / "part1"))
    year.mkdir()
    for part in (tmp_path / "part1").glob("*.parquet"):
        part.rename(year / "2020.parquet")
    (year / "note.txt").write_text("not data")
    make("date date, ret double", ("2020-01-31", 1.0)).write.parquet(str(tmp_path / "macro_features.parquet"))
    return str(tmp_path)


def test_resolution_and_coercion(spark, raw):
    tables = S.resolve_tables(spark, raw)
    assert set(tables) == {"crsp_names", "crsp_monthly", "macro_features"}
    names = rows_of(tables["crsp_names"], "permno", "shrcd", "namedt")
    assert names == [(1, 10, dt.date(2000, 1, 1)), (1, 11, dt.date(2000, 1, 1)), (None, None, None)]
    assert tables["crsp_monthly"].first().prc is None
    catalog = {r.table_name: r for r in S.source_catalog(spark, raw).collect()}
    assert catalog["crsp_monthly"].file_count == 1 and catalog["crsp_names"].row_count == 3
    spans = {r.date_column: r for r in catalog["crsp_names"].date_ranges}
    assert spans["namedt"].parse_failures == 1 and spans["nameenddt"].max_date == dt.date(2001, 1, 31)
    with pytest.raises(FileNotFoundError):
        S.source_catalog(spark, raw + "/missing")


def test_contract_report(spark, raw):
    report = {r.table_name: r for r in C.contract_report(spark, S.resolve_tables(spark, raw, coerce=False)).collect()}
    assert len(report) == 11
    assert report["crsp_monthly"].ok and report["crsp_monthly"].duplicate_count == 0
    names = report["crsp_names"]
    assert not names.ok and names.parse_failures == 1 and names.duplicate_count == 1
    assert report["macro_features"].missing_columns == "sp500,nasdaq,treasury_2y,treasury_10y" and not report["macro_features"].ok
    assert not report["ibes_link"].found


def test_contract_figures_take_one_scan_and_equal_the_single_checks(spark, make, capsys):
    contract = C.CONTRACTS["crsp_names"]
    types = {"permno": "long", "shrcd": "int", "exchcd": "int"}
    schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in contract.required)
    values = {"permno": 1, "namedt": "2000-01-01"}
    def row(**changed):
        return tuple((values | changed).get(n) for n in contract.required)
    df = make(schema, row(), row(), row(namedt="bad", nameenddt="2001-01-31"), row(permno=None), row(permno=None), row(permno=2))
    got = C.contract_figures(df, contract).first()
    single = {r.date_column: r for r in C.date_profile(df, ["namedt", "nameenddt"]).collect()}
    assert [tuple(d) for d in got.dates] == [tuple(single[d.date_column])[:5] for d in got.dates] and len(got.dates) == 2
    assert got.row_count == 6 and got.parse_failures == 1
    assert got.duplicate_count == C.duplicate_key_count(df, contract.key).first().duplicate_count == 2
    empty = C.contract_figures(df.where("false"), contract).first()
    assert (empty.row_count, empty.duplicate_count, empty.parse_failures) == (0, 0, 0)
    narrow = C.contract_figures(df.select("permno"), contract).first()
    assert narrow.duplicate_count is None and narrow.row_count == 6 and narrow.dates == []
    C.contract_figures(df, contract).explain()
    plan = capsys.readouterr().out
    assert plan.count("Scan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_duplicates_and_unique_keys(make):
    df = make("a int, b int", (1, 1), (1, 1), (1, None), (1, None), (1, None), (2, 1))
    row = C.duplicate_key_count(df, ["a", "b"]).first()
    assert (row.rows_checked, row.duplicate_count, row.severity) == (6, 3, "warning")
    with pytest.raises(ValueError, match="3 rows repeat"):
        C.require_unique(df, ["a", "b"], "t")
    with pytest.raises(ValueError, match="missing columns"):
        C.require_unique(df, ["c"], "t")


def test_summary(make):
    got = {r.column_name: r for r in C.table_summary(make("d string, x int", ("2020-01-31", 1), ("bad", None), (None, None)), "d").collect()}
    assert got["x"].missing_values == 2 and got["d"].invalid_dates == 2 and got["d"].start_date == dt.date(2020, 1, 31)


def test_read_and_write_by_suffix(spark, make, tmp_path):
    df = make("a int, b string", (1, "x"), (2, None))
    for suffix in ("csv", "parquet"):
        path = str(tmp_path / "deep" / f"t.{suffix}")
        S.write_dataset(df, path)
        assert rows_of(S.read_dataset(spark, path, "a int, b string")) == [(1, "x"), (2, None)]
    for call in (lambda: S.write_dataset(df, "t.json"), lambda: S.read_dataset(spark, "t.json")):
        with pytest.raises(ValueError):
            call()


def test_null_typed_file_reads_with_a_schema(spark, tmp_path):
    folder = str(tmp_path / "years")
    spark.sql("SELECT 1L AS permno, CAST(NULL AS VOID) AS x").selectExpr("permno", "CAST(x AS INT) AS y").write.parquet(folder + "/a")
    schema = spark.range(1).selectExpr("id AS permno", "CAST(1 AS DOUBLE) AS x").schema
    assert S.read_parquet(spark, folder + "/a", schema).first().x is None


def test_prepared_merge(spark, make, tmp_path):
    key = "permno long, formation_date date"
    first = make(key + ", a int", (1, "2020-01-31", 1), (2, "2020-01-31", 2))
    second = make(key + ", a int, b int", (1, "2020-01-31", 9, 5))
    other = make("x int", (1,))
    merged = S.merge_prepared_features([other, first, second])
    assert rows_of(merged, "permno", "a", "b") == [(1, 1, 5), (2, 2, None)]
    assert "a_feat" in S.merge_prepared_features([first, second], clash_suffix="_feat").columns
    with pytest.raises(ValueError, match="repeat the key"):
        S.merge_prepared_features([first, second.unionByName(second)])
    with pytest.raises(ValueError):
        S.merge_prepared_features([other])
    assert S.prepared_panel(first.withColumn("formation_date", F.col("formation_date").cast("string"))).schema["formation_date"].dataType.typeName() == "date"


def test_score_store_prunes(spark, make, tmp_path):
    scores = make("formation_date date, permno long, factor_id string, factor_score double",
                  *[(d, p, f, 1.0) for d in ("2020-01-31", "2020-02-29") for p in (1, 2) for f in ("a", "b")])
    path = str(tmp_path / "scores")
    S.write_scores(scores, path)
    chosen = S.read_selected_scores(spark, path, ["a"])
    assert chosen.count() == 4 and chosen.where("formation_date = DATE'2020-01-31'").count() == 2
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(factor_id), EqualTo(factor_id,a)]" in plan or "In(factor_id" in plan


def test_run_links_and_job_sinks(spark, make, tmp_path):
    df = make("a int", (1,))
    S.write_run(spark, str(tmp_path / "run"), {"predictions": df, "feature_importance": df}, {"run_id": "r", "model": "ridge"})
    manifest = spark.read.json(str(tmp_path / "run" / "manifest.json")).first()
    assert manifest.run_id == "r" and manifest.tables == ["predictions", "feature_importance"]
    assert spark.read.parquet(str(tmp_path / "run" / "predictions.parquet")).count() == 1
    S.write_links(str(tmp_path / "links"), df, df, df)
    assert spark.read.json(str(tmp_path / "links" / "link_diagnostics.json")).count() == 1
    jobs = make("job_id string, state string", ("j", "QUEUED"), ("k", "FAILED"))
    events = make("job_id string, event_id long", ("j", 1), ("j", 2))
    S.export_jobs(jobs, str(tmp_path / "jobs"))
    S.export_jobs(jobs, str(tmp_path / "history"), events)
    assert spark.read.json(str(tmp_path / "history")).count() == 3
    S.export_jobs(jobs, str(tmp_path / "nested"), make("job_id string, event_id long, kind string", ("j", 2, "b"), ("j", 1, "a")), nested=True)
    nested = {r["job_id"]: r for r in spark.read.json(str(tmp_path / "nested")).collect()}
    assert [(e["event_id"], e["kind"]) for e in nested["j"]["events"]] == [(1, "a"), (2, "b")] and nested["k"]["events"] is None
    assert all(r["exported_at"] for r in nested.values())


def test_stages_follow_the_shared_folder(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    staged = staging.stage(spark.range(3).toDF("x"), "follow")
    assert staged.count() == 3 and len(list(folder.glob("factorloom/*/follow-*"))) == 1
    assert staged.columns == ["x"] and "FileScan" in staged._jdf.queryExecution().executedPlan().toString()


def test_shared_stages_are_built_once(spark):
    calls = []
    build = lambda: calls.append(1) or spark.range(2)
    for _ in range(2):
        assert staging.shared_stage(spark, "once", "here", build).count() == 2
    staging.forget_shared_stages()
    staging.shared_stage(spark, "once", "here", build)
    assert len(calls) == 2


def test_years_of_different_types_are_read_as_one_table(spark, tmp_path):
    """A year whose prices are all missing was written with another type."""
    folder = tmp_path / "monthly_crsp_msf_by_year"
    spark.sql("SELECT 1L AS permno, DATE '2019-01-31' AS date, 5.5D AS prc").coalesce(1).write.parquet(str(folder / "y2019.parquet"))
    spark.sql("SELECT 2L AS permno, DATE '2020-01-31' AS date, CAST(NULL AS INT) AS prc").coalesce(1).write.parquet(str(folder / "y2020.parquet"))
    contract = C.CONTRACTS["crsp_monthly"]
    parts = [str(p) for p in sorted(folder.glob("*/*.parquet"))]
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, part in enumerate(parts):
        (flat / f"y{k}.parquet").write_bytes(open(part, "rb").read())
    got = S.read_contract(spark, str(flat), contract).orderBy("permno").collect()
    assert [(r.permno, r.prc) for r in got] == [(1, 5.5), (2, None)]


def test_json_payloads(spark):
    from factorloom.functions.scalars import json_fields, json_payload

    df = spark.sql("SELECT 'x' AS b, 1 AS a, CAST(NULL AS STRING) AS c")
    assert df.select(json_payload(["b", "c", "a"])).first()[0] == '{"a":1,"b":"x","c":null}'
    texts = spark.createDataFrame([(0, '{"a":1,"b":"x"}'), (1, "5"), (2, None), (3, "")], "k int, t string").select("k", json_fields("t").alias("f"))
    assert [r.f for r in texts.orderBy("k").collect()] == [{"a": "1", "b": "x"}, {"value": "5"}, {}, {}]
