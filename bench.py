"""Wall time of the headline queries; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results are
computed completely and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from ledgerlane.catalog.queries import all_queries
from ledgerlane.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINES = (
    "int_order_event_summary",
    "fct_orders",
    "fct_daily_revenue",
    "insight_01_revenue_gap",
    "insight_02_conflict_flags",
    "insight_03_status_kpis",
    "insight_04_daily_revenue",
    "insight_05_average_order_value",
    "insight_06_top_customers",
    "insight_07_payment_to_shipment",
    "insight_08_event_coverage_pct",
    "insight_09_orders_without_events",
    "revenue_metrics",
    "daily_revenue_ma7",
    "completed_missing_events",
    "dq_r001",
    "dq_r008",
    "dq_r009",
    "dq_r010",
    "dq_r013",
    "dq_failure_counts",
    "dq_report",
    "dq_report_clean",
    "dq_failed_samples",
)


def main() -> None:
    shared = Path(__file__).resolve().parent / "spark-warehouse" / "bench"
    spark = local_session("bench", CPUS, spark__checkpoint__dir=str(shared))
    queries = all_queries()
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
