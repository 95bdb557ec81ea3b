"""Operators called from a driver in another folder: the workers get the package from the driver."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_operators_run_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import public_tokenizers
        from pyspark.sql import SparkSession
        from factorloom.llm import jaccardjoin, tokencounts
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "2").getOrCreate())
        docs = spark.createDataFrame([(k, "some words that are counted here") for k in range(3)], "doc_id long, text string")
        counted = tokencounts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=512)
        print("found", counted.count(), jaccardjoin.components(docs).select("component_id").distinct().count())
    """))
    import public_tokenizers

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(public_tokenizers.__file__)))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 3 1" in done.stdout, done.stderr[-2000:]
