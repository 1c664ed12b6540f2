"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run in full (every row produced, nothing collected) after one warm-up of the
session on the flagship query.
"""

import json
import os
import time

from sparkgauge.plans import catalog
from sparkgauge.session import local_session, remove_run

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "s3_p1_p17_decoded_tasks",
    "p6_task_disks",
    "s1_s5_one_pass",
    "j1_job_tasks",
    "j2_orphan_tasks",
    "a10_a11_a9_stage_summary",
    "a15_load_balance",
    "a4_a8_executor_stage_metrics",
    "a7_j4_executor_stage_disks",
    "a1_task_runtime_summary",
    "a2_a3_utilization_reference",
    "w3_compute_cdf",
    "m1_m4_ideal_stage",
    "m8_m9_ideal_job",
    "m10_what_if_in_memory",
    "g3_sort_phases",
    "g5_k9_t4_benchmark_lines",
    "g9_p20_monitor_samples",
    "w5_started_deltas",
    "w7_w8_waterfall",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    catalog.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS, "bench", shuffle_partitions=int(CPUS))
    run(spark, "m8_m9_ideal_job")
    times = {name: run(spark, name) for name in HEADLINE}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))
    remove_run(spark)
    spark.stop()


if __name__ == "__main__":
    main()
