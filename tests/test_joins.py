"""Attribution gives the same rows whatever join the planner picks and however keys are salted."""

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import attribution, rollup
from sparkgauge.plans import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, value in old.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def figures(spark, salts):
    # Every task moves to one stage that holds most rows.
    tasks = fixtures.tasks(spark, SF).withColumn(
        "stage_id", F.when(F.col("task_id") % 10 < 8, 7).otherwise(F.col("stage_id"))
    )
    attached = attribution.attach_jobs(tasks, fixtures.job_stages(spark, SF), salts)
    return rollup.executor_stage_metrics(attached, disks=False)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_same_rows_with_and_without_broadcast(spark, no_broadcast):
    shuffled = figures(spark, 8)
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # The partial aggregate sits between the join and the shuffle of its results.
    assert plan.index("partial_min_by") > plan.index("Exchange") and plan.index("partial_min_by") < plan.index("SortMergeJoin")
    expected = rows(shuffled)
    assert rows(figures(spark, 1)) == expected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert rows(figures(spark, 8)) == expected


def test_orphans_and_attributed_tasks_are_all_tasks(spark, no_broadcast):
    tasks, starts = fixtures.tasks(spark, SF), fixtures.job_stages(spark, SF)
    attached = attribution.attach_jobs(tasks, starts).select("app_id", "task_id", "launch_ms", "finish_ms", "executor_id").distinct()
    orphans = attribution.orphan_tasks(tasks, starts).select("app_id", "task_id", "launch_ms", "finish_ms", "executor_id").distinct()
    everything = tasks.select("app_id", "task_id", "launch_ms", "finish_ms", "executor_id").distinct()
    assert attached.union(orphans).exceptAll(everything).count() == 0
    assert everything.exceptAll(attached.union(orphans)).count() == 0
