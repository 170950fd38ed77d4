"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Passes over the same queries at the target scale, each query rebuilt
from scratch (new DataFrames, no cached data or reused shuffle files):
the first runs on a cold JVM and is reported as ``queries_cold``; of the
``WARM`` that follow, with JIT-compiled code, the median of each query is the
headline, since one pass alone is off by a second or two. A query's time
covers building its plan and running it to completion.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyroll.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
WARM = 3


def _collect(df):
    return len(df.collect())


def headline():
    from skyroll import registry as reg
    from skyroll.operators import aggregates as agg
    from skyroll.plans.run import run
    from skyroll.session import scratch_path

    def full_run(spark, sf_dir):
        root = scratch_path(spark, "bench-run")
        res = run(spark, reg.raw_sources(spark, sf_dir), f"{root}/json", f"{root}/store")
        return _collect(res.totals)

    q = reg.queries()
    return {
        "by_airline": lambda s, d: _collect(q["by_airline"](s, d)),
        "by_airport_top50": lambda s, d: _collect(q["by_airport_top50"](s, d)),
        "by_month": lambda s, d: _collect(q["by_month"](s, d)),
        "summary": lambda s, d: _collect(q["summary"](s, d)),
        "all_grains": lambda s, d: _collect(agg.grain_table(reg.flights(s, d))),
        "insights": lambda s, d: _collect(q["insights"](s, d)),
        "kpi_rows": lambda s, d: _collect(q["kpi_rows"](s, d)),
        "cancellation_top15": lambda s, d: _collect(q["cancellation_top15"](s, d)),
        "keyed_upsert": lambda s, d: _collect(q["keyed_upsert"](s, d)),
        "holidays_normalised": lambda s, d: _collect(q["holidays_normalised"](s, d)),
        "full_run": full_run,
    }


def main():
    spark = build_session(f"local[{CPUS}]", app_name="skyroll-bench",
                          shuffle_partitions=max(CPUS, 1), extra={
                              "spark.ui.enabled": "false",
                              "spark.ui.showConsoleProgress": "false",
                              "spark.driver.memory": "16g",
                              # throughput collector: the usual choice for batch
                              # executors (set executor-side too on a cluster)
                              "spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
                          })
    spark.sparkContext.setLogLevel("ERROR")
    queries = headline()
    passes = []
    for _ in range(1 + WARM):
        times = {}
        for name, fn in queries.items():
            t0 = time.perf_counter()
            fn(spark, SF_DIR)
            times[name] = round(time.perf_counter() - t0, 3)
        passes.append(times)
    cold = passes[0]
    warm = {name: median(p[name] for p in passes[1:]) for name in queries}
    # fact rows = lineitem rows (one generated flight per line item); the
    # parquet row count comes from file metadata
    fact_rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "queries_cold": cold,
        "cold_value": round(sum(cold.values()), 3),
        "fact_rows": fact_rows,
        "full_run_rows_per_sec": round(fact_rows / warm["full_run"]),
        "sf": float(m.group(1)) if m else SF_DIR,
        "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
