"""Chunked sink: broken-off runs, changed plans, caps, and the label stage as one operator."""

import pytest
from pyspark.sql import functions as F

from factorloom.operators import panel as P
from factorloom.sources import chunks as K
from tests.conftest import rows_of


@pytest.fixture()
def panel(make):
    rows = [(f"2001-{m:02d}-28", p, float(m * p)) for m in range(1, 11) for p in range(1, 4 + m)]
    return make("formation_date date, permno long, x double", *rows)


class Stop(Exception):
    pass


def stop_at(number):
    def check(chunk):
        if chunk.number == number:
            raise Stop
    return check


def test_a_run_goes_on_where_it_broke_off(spark, panel, tmp_path):
    location = str(tmp_path / "scores")
    double = lambda rows: rows.withColumn("x", F.col("x") * 2).withColumn("factor_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    with pytest.raises(Stop):
        K.write_chunks(panel, location, make=double, dates_per_chunk=3, before_chunk=stop_at(2))
    half = K.read_chunks(spark, location)
    assert half.select("formation_date").distinct().count() == 6
    written = K.write_chunks(panel, location, make=double, dates_per_chunk=3)
    assert [c.number for c in written] == [2, 3]
    assert K.write_chunks(panel, location, make=double, dates_per_chunk=3) == []
    columns = ("formation_date", "permno", "x", "factor_id")
    assert rows_of(K.read_chunks(spark, location), *columns) == rows_of(double(panel), *columns)
    figures = [(r["chunk"], r["dates"], r["rows"]) for r in K.entered_chunks(spark, location).orderBy("chunk").collect()]
    assert [f[:2] for f in figures] == [(0, 3), (1, 3), (2, 3), (3, 1)] and sum(f[2] for f in figures) == panel.count()


def test_files_of_a_chunk_that_broke_off_are_not_seen_and_replaced(spark, panel, tmp_path):
    location = str(tmp_path / "scores")
    K.write_chunks(panel.where("formation_date < '2001-04-01'"), location, dates_per_chunk=3)
    # what a run left that ended between the write and the entry in the manifest
    panel.where("formation_date = '2001-04-28'").limit(2).withColumn("x", F.lit(-1.0)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("formation_date").parquet(f"{location}/table")
    assert K.read_chunks(spark, location).where("x < 0").count() == 0
    assert [c.number for c in K.write_chunks(panel, location, dates_per_chunk=3)] == [1, 2, 3]
    assert rows_of(K.read_chunks(spark, location), "formation_date", "permno", "x") == rows_of(panel)


def test_changed_input_or_tag_writes_the_chunk_again(spark, panel, tmp_path):
    location = str(tmp_path / "scores")
    K.write_chunks(panel, location, dates_per_chunk=5, tag="one")
    fewer = panel.where("NOT (formation_date = '2001-02-28' AND permno = 1)")
    assert [c.number for c in K.write_chunks(fewer, location, dates_per_chunk=5, tag="one")] == [0]
    assert rows_of(K.read_chunks(spark, location), "formation_date", "permno", "x") == rows_of(fewer)
    assert [c.number for c in K.write_chunks(fewer, location, dates_per_chunk=5, tag="two")] == [0, 1]


def test_large_dates_have_more_parts_and_too_large_chunks_are_refused(spark, panel, tmp_path):
    location = str(tmp_path / "scores")
    K.write_chunks(panel, location, dates_per_chunk=12, rows_per_part=5, sort=["permno"])
    files = {d: len(list((tmp_path / "scores" / "table" / f"formation_date={d}").glob("*.parquet"))) for d in ("2001-01-28", "2001-10-28")}
    assert files["2001-01-28"] == 1 and files["2001-10-28"] >= 2
    with pytest.raises(ValueError, match="more than 20"):
        K.write_chunks(panel, str(tmp_path / "other"), dates_per_chunk=3, most_rows=20)
    with pytest.raises(ValueError, match="without formation_date"):
        K.write_chunks(panel.withColumn("formation_date", F.lit(None).cast("date")), str(tmp_path / "other"))
    with pytest.raises(ValueError):
        K.plan_chunks(panel, dates_per_chunk=0)
    assert K.write_chunks(panel.limit(0), str(tmp_path / "none")) == []
    with pytest.raises(FileNotFoundError):
        K.read_chunks(spark, str(tmp_path / "none"))


def test_label_stage_writes_the_checked_panel(spark, make, tmp_path):
    months = [f"2000-{m:02d}-28" for m in range(1, 13)]
    monthly = make(
        "permno long, permco long, date date, prc double, ret double, retx double, shrout double, vol double, cfacpr double, cfacshr double",
        *[(p, p, d, 10.0, 0.01 * (k + p), 0.0, 100.0, 5.0, 1.0, 1.0) for p in (1, 2, 3) for k, d in enumerate(months)])
    names = make("permno long, namedt date, nameenddt date, shrcd int, exchcd int, ticker string",
                 *[(p, "1990-01-01", None, 10 if p < 3 else 73, 1, "T") for p in (1, 2, 3)])
    location = str(tmp_path / "labels")
    written, checked = K.label_stage(monthly, names, location, max_rows=15, dates_per_chunk=5)
    want = P.cap_rows(P.monthly_panel(monthly, names), 15)
    assert rows_of(written) == rows_of(want.select(*written.columns))
    row = checked.first()
    assert row["rows"] == 15 and row["early_windows"] == 0 and row["max_rows"] == 15
    assert K.entered_chunks(spark, location).count() == 3
    K.label_stage(monthly, names, location, max_rows=15, dates_per_chunk=5)
    assert rows_of(K.read_chunks(spark, location).select(*written.columns)) == rows_of(written)
