"""Time the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Tables that several queries derive from the input (panel, labels, predictions, series) are built once
and timed under `build_*`; a query's own time is the time to run it over them in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidepanel.plans import catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# The same run as another query, the sum of steps that are timed one by one, or slow by the number of model fits.
SKIP = {
    "walk_forward_rows", "walk_forward_metrics", "oof_pattern", "preprocess_run", "clean_run", "walk_forward_summary", "walk_forward", "random_search",
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query

    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        t = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    for name in ("panel", "labelled", "predictions", "series_wide", "feature_years", "feature_store"):
        timed(f"build_{name}", lambda n=name: getattr(catalog, n)(spark, SF_DIR))
    only = sys.argv[1:]
    for name, fn in catalog.QUERIES.items():
        if name in SKIP if not only else name not in only:
            continue
        timed(name, lambda f=fn: f(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
