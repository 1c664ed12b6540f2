"""What grows with the log: text is not written, moved or sorted before it is needed."""

import time
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from sparkgauge import schemas
from sparkgauge.operators import utilization, waterfall
from sparkgauge.plans import fixtures
from sparkgauge.session import CLEANUP_CONF, materialize, run_dir
from sparkgauge.sources import event_log

SF = "/root/testdata/sf0.001"


def test_event_text_is_read_from_the_given_table(spark):
    lines = fixtures.event_lines(spark, SF)
    assert {f.removeprefix("file://") for f in lines.inputFiles()} == {f"{SF}/lineitem.parquet"}


def test_intermediate_tables_are_zstandard(spark):
    fixtures.job_stages(spark, SF)
    written = [p for p in Path(run_dir(spark)).rglob("*.parquet")]
    assert written and all(p.name.endswith(".zstd.parquet") for p in written)


def test_long_logs_are_rolled_more_often(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROLL_LINES", 100)
    lines = event_log.read_lines(spark, f"{fixtures.event_files(spark, SF)}/eventlog_v2_*/events_*")
    per_app = lines.groupBy("app_id").agg(F.count_distinct(F.floor(F.col("pos") / event_log.FILE_STRIDE)).alias("n"))
    assert lines.count() == fixtures.table(spark, SF, "lineitem").count()
    assert min(r["n"] for r in per_app.collect()) > 3


def test_jobs_of_stages_are_a_table_of_known_size(spark):
    stages = fixtures.job_stages(spark, SF)
    assert stages.inputFiles() and all(run_dir(spark) in f for f in stages.inputFiles())


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "DEALT_ROWS", 100)
    lineitem = fixtures.table(spark, SF, "lineitem")
    parts = fixtures.dealt(lineitem, "l_orderkey").rdd.getNumPartitions()
    assert parts == -(-lineitem.count() // 100)


def test_monitor_files_move_no_samples(spark, monkeypatch):
    shuffled = []
    deal = DataFrame.repartition

    def noted(df, *args):
        shuffled.extend(df.columns)
        return deal(df, *args)

    monkeypatch.setattr(DataFrame, "repartition", noted)
    fixtures.monitor_files(spark, SF)
    assert shuffled and "sample" not in shuffled


def test_events_of_few_fields_are_the_same_events(spark):
    value = F.when(F.col("pos.l_linenumber") == 2, F.expr("substring(value, 1, length(value) - 9)"))
    lines = fixtures.event_lines(spark, SF).withColumn("value", F.coalesce(value, F.col("value")))

    def figures(events):
        return events.agg(F.count(F.lit(1)), F.sum(F.col("event.Task Info.Task ID"))).first()

    few, whole = (event_log.task_end_events(lines, s) for s in (schemas.TASK_IDS, schemas.TASK_END))
    assert figures(few) == figures(whole)


def test_no_shuffle_files_are_left_behind_a_table(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    local = [Path(folder) for folder in manager.localDirsString()]

    def shuffled():
        return {p for folder in local for p in folder.rglob("shuffle_*.data")}

    before = shuffled()
    counted = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert counted.count() == 7 and spark.conf.get(CLEANUP_CONF, "false") == "false"


def test_entries_of_a_task_are_not_filtered_row_by_row(spark):
    raw = fixtures.raw_tasks(spark, SF)
    lists = raw.select("exec_no", fixtures._disk_list().alias("disks"))
    pairs = utilization.utilization_pairs(fixtures.tasks(spark, SF).withColumn("app_id", F.lit("a")))
    for frame in (lists, pairs):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "filter(array(" not in plan
    names = lists.select("exec_no", F.transform("disks", lambda d: F.map_keys(d)[0]).alias("names")).distinct()
    every = list(fixtures.DISKS)
    for row in names.collect():
        assert row["names"] == [d for d in every if row["exec_no"] != 4 or d != "xvdf"]
    fetched = pairs.where("measure = 'network_utilization_fetch_only'").count()
    assert fetched == 2 * raw.where("fetch_wait is not null").count()


def test_a_work_line_is_made_and_split_once(spark):
    """Also by the filters that are pushed below the fields."""
    parsed = waterfall.parse_work_lines(fixtures.work_lines(spark, SF))
    readable = parsed.where("kind is not null and id is not null and start_ms is not null and runtime_ms is not null")
    plan = readable._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("concat_ws(") == 1
