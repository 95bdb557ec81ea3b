"""Times the headline queries and prints one JSON line.

Every query starts from the source tables: staged inputs are forgotten before each run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from factorloom.catalog.queries import REGISTERED
from factorloom.plans.staging import forget_shared_stages

HEADLINE = (
    "monthly_panel", "universe_point_in_interval", "forward_returns", "fundamentals_asof", "estimate_features_asof",
    "factor_scores_global", "factor_long_short_returns", "quantile_sweep", "ridge_factor_forecast", "stock_score",
    "qspread_portfolio", "ic_by_period", "prediction_metrics", "job_transition_audit", "text_pattern_findings",
    "broken_links",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("factorloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # no call-site capture for every column expression on the driver
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    seconds, failed = {}, {}
    for name in names:
        forget_shared_stages()
        start = time.perf_counter()
        try:
            REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the others are still timed; the exit code tells
            failed[name] = f"{type(error).__name__}: {error}"[:300]
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line | ({"failed": failed} if failed else {})))
    spark.stop()
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
