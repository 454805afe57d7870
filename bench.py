"""Benchmark: run every registered query over the whole tables of one scale
factor and print one JSON line with per-query wall seconds.

Each query is fully executed into the ``noop`` sink (every row produced, no
collect to the driver). Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8), BENCH_REPEAT (default 1: one run per query; with more,
the first run is reported as "queries" and the median of the others as "warm").
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quadflow.plans.catalog import queries  # noqa: E402
from quadflow.session import get_session  # noqa: E402

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", "quadflow-bench", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(100000).selectExpr("sum(id)").collect()  # JVM warm-up
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    times: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name, fn in sorted(queries().items()):
        runs = []
        for _ in range(repeat):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - start, 3))
        times[name] = runs[0]
        if repeat > 1:
            warm[name] = statistics.median(runs[1:])
    match = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(match.group(1)) if match else sf_dir, "cpus": cpus}
    if warm:
        out["warm"] = warm
        out["warm_total"] = round(sum(warm.values()), 3)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
