import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_grouped_fit_runs_from_another_folder(tmp_path):
    """The workers get the package from the driver, not from its folder or path."""
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import datetime
        from pyspark.sql import SparkSession
        from factorloom.operators import models
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "2").getOrCreate())
        day = datetime.date(2020, 1, 31)
        rows = spark.createDataFrame([(day, "f", 0.1 * k, "train", 1, float(k)) for k in range(4)],
                                     "formation_date date, factor_id string, factor_long_short_ret_1m double, role string, fold int, x double")
        print("rows", models._grouped_fit(rows, ["x"], models.ridge_fit(1.0)).count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 4" in done.stdout, done.stderr[-2000:]
