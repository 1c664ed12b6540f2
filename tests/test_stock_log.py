"""An event log as plain Spark writes it: rolled and compressed, without machine counters."""

import subprocess
import sys
from pathlib import Path

import pytest

from sparkgauge.operators import attribution, ideal, rollup
from sparkgauge.operators.tasks import tasks_from_events
from sparkgauge.sources import event_log

JOB = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").appName("tiny").config("spark.ui.enabled", "false")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + sys.argv[1])
    .config("spark.eventLog.rolling.enabled", sys.argv[2]).config("spark.eventLog.compress", sys.argv[2])
    .config("spark.sql.shuffle.partitions", "3").config("spark.sql.adaptive.enabled", "false").getOrCreate())
spark.range(1000).repartition(3).groupBy((F.col("id") % 5).alias("k")).count().collect()
spark.range(10).count()
spark.stop()
"""


@pytest.mark.parametrize("rolled", ["true", "false"])
def test_stock_log(spark, tmp_path, rolled):
    subprocess.run(
        [sys.executable, "-c", JOB, str(tmp_path), rolled], check=True, timeout=300, capture_output=True
    )
    files = [str(p) for p in Path(tmp_path).rglob("*") if p.is_file() and not p.name.startswith(("appstatus", "."))]
    lines = event_log.read_lines(spark, files)
    assert event_log.bad_lines(lines).count() == 0
    starts = event_log.job_start_events(lines)
    assert event_log.jobs_from_events(starts).where("name IS NULL OR submit_ms IS NULL").count() == 0
    tasks = tasks_from_events(
        event_log.task_end_events(lines), has_fetch_rule="bytes>0", cpu_source="executor_cpu_time"
    )
    job_stages = event_log.job_stages_from_events(starts)
    attached = attribution.attach_jobs(tasks, job_stages)
    assert attribution.orphan_tasks(tasks, job_stages).count() == 0
    assert attached.count() == tasks.count() > 6
    models = ideal.ideal_stage(rollup.executor_stage_metrics(attached)).collect()
    assert any(m["has_shuffle_read"] for m in models) and not all(m["has_shuffle_read"] for m in models)
    assert all(m["ideal_cpu_s"] > 0 and m["ideal_network_s"] is None for m in models)
