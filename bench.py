"""Headline queries: wall time after one warm-up run, whole result written to the no-op sink.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelyard import get_session, plans  # noqa: E402

HEADLINES = [
    "s1_dated_snapshots",
    "w1_daily_change",
    "w3_exposure",
    "w6_recent_rows_with_ties",
    "w10_holm",
    "c1_panel_metrics",
    "c2_totals_over_time",
    "c4_recent_active_window",
    "c5_forecast_grid_observed",
    "c7_outer_merge",
    "c8_policy_panel",
    "c9_feature_table",
    "c10_key_coverage",
    "a11_histogram_faceted",
    "r5_transpose_indicators",
    "m1_linear_regression",
    "m3_adjusted_p_values",
    "m4_mixed_model",
    "m5_nested_mixed_model",
    "m6_mixed_forecast",
    "m8_binomial_mixed_model",
    "v5_total_cost",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.queries(), {}
    for name in HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
