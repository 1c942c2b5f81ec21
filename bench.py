"""Headline timings.  Prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3).  Each query is built and fully executed into the
``noop`` sink (no driver collect); one warm-up, then the median of the repeats.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tollgate.plans import catalog  # noqa: E402
from tollgate.session import build_session, release_shared  # noqa: E402

HEADLINE = ["redact_text", "pii_counts", "cumulative_cost", "budget_admission", "breaker_states",
            "team_budget_status", "route_resolution", "kpi_summary", "request_ingest", "response_assembly"]
#: timed too, outside the total
FURTHER = ["provider_health", "detector_plugin", "redact_messages", "request_job", "stream_daily_usage", "stream_budget_admission",
           "stream_breaker", "stream_audit_sink", "stream_kpi"]


def run_once(spark, name, sf_dir):
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, app="tollgate-bench",
                          extra={"spark.driver.memory": "16g"})
    times = {}
    for name in HEADLINE:
        run_once(spark, name, sf_dir)
        times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(repeat)), 3)
    total = round(sum(times.values()), 3)
    for name in FURTHER:
        run_once(spark, name, sf_dir)
        times[name] = round(run_once(spark, name, sf_dir), 3)
        release_shared(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_median_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
