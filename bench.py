"""Time the headline queries end to end and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. Every query runs over the whole
tables into the no-op sink, after one warm-up of the session on the smallest of them.
"""

from __future__ import annotations

import json
import os
import time

from larder.registry.queries import QUERIES
from larder.session import build_session

HEADLINES = (
    "daily_sales", "training_frame", "ridge_by_series", "alpha_search", "holdout_metrics",
    "recursive_forecast", "forecast_end_to_end", "recipe_need", "restock_flags", "safety_rop", "surplus_rank",
    "daily_signals", "weekly_balance_plan", "schedule_plan", "schedule_advisories", "weekly_advisories",
    "accuracy_report", "season_run", "weekly_run", "entry_slice",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": str(2 * int(cpus)),
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["table_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only.split(",") if only else HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
