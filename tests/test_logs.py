"""Logs as files: order, rolling, compression, broken lines, missing sections."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import attribution
from sparkgauge.operators.tasks import tasks_from_events, with_input_size
from sparkgauge.sources import event_log, monitor_log


def job_start(job, stages, submit=0):
    return {
        "Event": "SparkListenerJobStart",
        "Job ID": job,
        "Submission Time": submit,
        "Stage IDs": stages,
        "Stage Infos": [{"Stage ID": s, "Stage Name": f"stage {s}"} for s in stages],
    }


def task_end(task, stage, launch=1000, finish=2000, executor="0", info=(), **metrics):
    base = {
        "Executor Run Time": finish - launch - 30,
        "Executor Deserialize Time": 10,
        "Result Serialization Time": 5,
        "JVM GC Time": 7,
    }
    base.update(metrics)
    return {
        "Event": "SparkListenerTaskEnd",
        "Stage ID": stage,
        "Task Info": {
            "Task ID": task,
            "Launch Time": launch,
            "Finish Time": finish,
            "Host": f"host-{executor}",
            "Executor ID": executor,
            "Locality": "ANY",
            **dict(info),
        },
        "Task Metrics": base,
    }


def write(path, events):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "".join((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in events)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def read(spark, *paths, **options):
    return event_log.read_lines(spark, list(paths), **options)


def job_tasks(lines):
    starts = event_log.job_stages_from_events(event_log.job_start_events(lines))
    tasks = tasks_from_events(event_log.task_end_events(lines))
    return attribution.attach_jobs(tasks, starts), attribution.orphan_tasks(tasks, starts)


def test_missing_sections_get_defaults(spark, tmp_path):
    log = write(tmp_path / "event_log", [task_end(1, 0)])
    row = with_input_size(tasks_from_events(event_log.task_end_events(read(spark, log)))).collect()[0]
    assert row["app_id"].endswith(str(tmp_path))
    assert (row["runtime_ms"], row["scheduler_delay_ms"]) == (1000, 15)
    assert (row["start_gc_total"], row["end_gc_total"]) == (-7, 0)
    assert row["disks"] == {} and row["compute_ms"] == 0.0 and row["total_cpu"] == 0.0
    assert row["input_method"] == "unknown" and row["input_size_mb"] == 0.0
    assert row["has_fetch"] is False and row["data_local"] is False and row["output_on_disk"] is True
    assert row["remote_mb"] is None and row["start_tx_bytes"] is None


def test_repeated_disk_keeps_the_last_entry(spark, tmp_path):
    def disk(u):
        return {"xvdb": {"Disk Utilization": u, "Read Throughput": 1.0, "Write Throughput": "NaN"}}

    usage = {"Device Name To Utilization": [disk(0.1), {"xvdc": disk(0.3)["xvdb"]}, disk(0.2)]}
    log = write(tmp_path / "event_log", [task_end(1, 0, **{"Disk Utilization": usage})])
    disks = tasks_from_events(event_log.task_end_events(read(spark, log))).collect()[0]["disks"]
    assert {k: v["Disk Utilization"] for k, v in disks.items()} == {"xvdb": 0.2, "xvdc": 0.3}
    assert disks["xvdb"]["Write Throughput"] != disks["xvdb"]["Write Throughput"]


def test_shared_stage_counts_in_every_job_started_before(spark, tmp_path):
    log = write(
        tmp_path / "event_log",
        [
            task_end(0, 1),
            job_start(0, [1]),
            task_end(1, 1),
            job_start(1, [1, 2]),
            task_end(2, 1),
            task_end(3, 2),
            {"Event": "SparkListenerTaskStart", "Stage ID": 1},
            task_end(4, 9),
        ],
    )
    attached, orphans = job_tasks(read(spark, log))
    assert sorted((r["job_id"], r["task_id"]) for r in attached.collect()) == [(0, 1), (0, 2), (1, 2), (1, 3)]
    assert sorted(r["task_id"] for r in orphans.collect()) == [0, 4]


def test_broken_lines_are_quarantined(spark, tmp_path):
    whole = json.dumps(task_end(1, 0))
    log = write(tmp_path / "event_log", [whole, whole[:-20], "garbage SparkListenerTaskEnd", "", whole])
    lines = read(spark, log)
    assert event_log.task_end_events(lines).count() == 2
    assert event_log.bad_line_counts(lines).collect()[0]["bad_lines"] == 3


@pytest.mark.parametrize("split_bytes", [4096, 1 << 27])
def test_position_is_log_order(spark, tmp_path, split_bytes):
    log = write(tmp_path / "event_log", [task_end(i, 0) for i in range(400)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        lines = read(spark, log)
        assert (lines.rdd.getNumPartitions() > 10) == (split_bytes == 4096)
        tasks = tasks_from_events(event_log.task_end_events(lines)).select("pos", "task_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["task_id"] for r in sorted(tasks)] == list(range(400))
    assert len({r["pos"] for r in tasks}) == 400


def test_rolled_and_compressed_logs_are_one_application(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app-1"
    paths = [
        write(folder / "events_2_app-1.gz", [task_end(10, 1), task_end(11, 1)]),
        write(folder / "events_10_app-1.gz", [task_end(12, 1)]),
        write(folder / "events_1_app-1.gz", [job_start(0, [1]), task_end(9, 1)]),
    ]
    lines = read(spark, *paths)
    tasks = tasks_from_events(event_log.task_end_events(lines)).select("app_id", "pos", "task_id").collect()
    assert {r["app_id"].rsplit("/", 1)[1] for r in tasks} == {"eventlog_v2_app-1"}
    assert [r["task_id"] for r in sorted(tasks, key=lambda r: r["pos"])] == [9, 10, 11, 12]
    attached, orphans = job_tasks(lines)
    assert attached.count() == 4 and orphans.count() == 0


def test_job_is_named_after_its_highest_stage(spark, tmp_path):
    log = write(tmp_path / "event_log", [job_start(3, [7, 9, 8], submit=5)])
    row = event_log.jobs_from_events(event_log.job_start_events(read(spark, log))).collect()[0]
    assert (row["job_id"], row["name"], row["submit_ms"]) == (3, "stage 9", 5)


def test_options_for_stock_logs(spark, tmp_path):
    read_zero = {"Fetch Wait Time": 0, "Local Blocks Fetched": 0, "Remote Blocks Fetched": 0, "Remote Bytes Read": 0, "Local Bytes Read": 0}
    read_some = {**read_zero, "Remote Bytes Read": 1048576}
    log = write(
        tmp_path / "event_log",
        [
            task_end(1, 0, **{"Shuffle Read Metrics": read_zero, "Executor CPU Time": 3000000}),
            task_end(2, 0, info={"Failed": True}, **{"Shuffle Read Metrics": read_some}),
        ],
    )
    events = event_log.task_end_events(read(spark, log))
    default = {r["task_id"]: r for r in tasks_from_events(events).collect()}
    assert default[1]["has_fetch"] and default[2]["has_fetch"] and default[1]["compute_ms"] == 0
    stock = {
        r["task_id"]: r
        for r in tasks_from_events(events, has_fetch_rule="bytes>0", cpu_source="executor_cpu_time").collect()
    }
    assert not stock[1]["has_fetch"] and stock[2]["has_fetch"] and stock[1]["compute_ms"] == 3.0
    assert tasks_from_events(events, success_only=True).count() == 1


def test_fields_of_another_type_lose_no_event(spark, tmp_path):
    lines = [
        f'{{"Event":"SparkListenerTaskEnd","Stage ID":1,"Task Info":{{"Task ID":{i}}},'
        f'"Task Metrics":{{"JVM GC Time":{gc}}}}}'
        for i, gc in enumerate(["7", "7.5", '"x"', "8"])
    ]
    path = tmp_path / "event_log"
    path.write_text("\n".join([*lines, lines[0][:60]]) + "\n")
    read = event_log.read_lines(spark, str(path))
    events = event_log.task_end_events(read).select("event.*").orderBy("Task Info.Task ID").collect()
    assert [e["Task Info"]["Task ID"] for e in events] == [0, 1, 2, 3]
    assert [e["Task Metrics"]["JVM GC Time"] for e in events] == [7, None, None, 8]
    assert event_log.odd_tasks(read).count() == 2
    assert event_log.bad_lines(read).count() == 1


def test_a_tick_with_an_odd_field_does_not_end_its_file(spark, tmp_path):
    lines = [
        f'{{"Current Time":{i},"Outstanding Network Bytes":{n}}}'
        for i, n in enumerate(["1", "2", "5.5", "4", '"x"', "6"])
    ]
    path = tmp_path / "1_executor_monitor"
    path.write_text("\n".join([*lines, lines[0][:20], lines[0]]) + "\n")
    read = monitor_log.read_monitor_lines(spark, str(tmp_path))
    whole = monitor_log.whole_samples(monitor_log.decode_samples(read))
    assert sorted(r["t"] for r in whole.select("sample.Current Time").toDF("t").collect()) == list(range(6))


def test_syntax_is_told_apart_from_types(spark, tmp_path):
    """Nine lines: every reader of the log makes the same of them."""

    def task(i, gc="7", more="", rate="1.5", event="SparkListenerTaskEnd"):
        return (
            f'{{"Event":"{event}","Stage ID":1,{more}"Task Info":{{"Task ID":{i}}},"Task Metrics":{{"JVM GC Time":{gc},'
            f'"Network Utilization":{{"Bytes Received Per Second":{rate}}}}}}}'
        )

    path = tmp_path / "event_log"
    texts = [
        task(0),
        task(1, gc="NaN"),
        task(2, gc="7.5", rate="NaN"),
        task(3, gc="7.5", more='"Stage ID":2,'),
        task(4, rate="-Infinity", more='"Stage ID":3,'),
        task(5, gc="NaN", event="SparkListenerTaskStart"),
        task(6, more='"Stage ID":2,', event="SparkListenerStageCompleted"),
        task(7)[:-9],
        task(8) + task(9),
    ]
    path.write_text("\n".join(texts) + "\n")
    read = event_log.read_lines(spark, str(path))
    events = event_log.task_end_events(read).select("event.*").orderBy("Task Info.Task ID").collect()
    assert [e["Task Info"]["Task ID"] for e in events] == [0, 1, 2, 3, 4]
    assert [e["Task Metrics"]["JVM GC Time"] for e in events] == [7, None, None, None, 7]
    assert [e["Stage ID"] for e in events] == [1, 1, 1, 2, 3]
    rates = [e["Task Metrics"]["Network Utilization"]["Bytes Received Per Second"] for e in events]
    assert rates[2] != rates[2] and rates[4] == float("-inf") and rates[0] == 1.5
    assert event_log.odd_tasks(read).count() == 3
    assert {r["value"] for r in event_log.bad_lines(read).collect()} == set(texts[7:])
    table = event_log.event_table(read)
    assert {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()} == {"task": 5, "broken": 2}
    assert {r["value"] for r in table.where("kind = 'broken'").collect()} == set(texts[7:])


def test_a_field_deep_in_a_list_takes_nothing_else_with_it(spark, tmp_path):
    def disk(sectors):
        return {"xvdb": {"Disk Utilization": 0.5, "Read Throughput": 1.0, "Write Throughput": 2.0,
                         "End Counters": {"Sectors Read": sectors, "Millis Total": 3}}}

    usage = {"Device Name To Utilization": [disk("many"), {"xvdc": disk(4)["xvdb"]}]}
    log = write(tmp_path / "event_log", [task_end(1, 0, **{"Disk Utilization": usage})])
    disks = tasks_from_events(event_log.task_end_events(read(spark, log))).collect()[0]["disks"]
    assert disks["xvdb"]["End Counters"].asDict() | disks["xvdc"]["End Counters"].asDict() != {}
    assert disks["xvdb"]["End Counters"]["Sectors Read"] is None
    assert disks["xvdb"]["End Counters"]["Millis Total"] == 3 and disks["xvdc"]["End Counters"]["Sectors Read"] == 4


def test_five_ticks_with_two_faults_each(spark, tmp_path):
    lines = [
        f'{{"Current Time":{i},"Outstanding Network Bytes":{n},"Network Utilization":{{"Bytes Received Per Second":{r}}}}}'
        for i, (n, r) in enumerate([("1", "1"), ("2", "2"), ("5.5", "NaN"), ("4", "Infinity"), ('5,"Current Time":4', "NaN")])
    ]
    (tmp_path / "1_executor_monitor").write_text("\n".join(["starting", *lines, lines[0] + "x", lines[0]]) + "\n")
    whole = monitor_log.whole_samples(
        monitor_log.decode_samples(monitor_log.read_monitor_lines(spark, str(tmp_path)))
    )
    rows = whole.select("sample.Current Time", "sample.Outstanding Network Bytes").toDF("t", "n").collect()
    assert sorted((r["t"], r["n"]) for r in rows) == [(0, 1), (1, 2), (2, None), (3, 4), (4, 5)]


def test_a_job_filter_comes_before_the_decoding(spark, tmp_path):
    """Only lines of the kept stages are decoded whole, and the tasks are those of the plain way."""
    events = [job_start(j, [2 * j, 2 * j + 1]) for j in range(10)]
    events += [task_end(100 * s + i, s) for s in range(20) for i in range(5)]
    events.insert(15, json.dumps(task_end(7, 3))[:-4])
    lines = read(spark, write(tmp_path / "event_log", events))
    starts = event_log.job_stages_from_events(event_log.job_start_events(lines))
    kept = starts.where("job_id = 3")
    found = event_log.task_end_events_of(lines, kept)
    wanted = event_log.task_end_events(lines).where(F.col("event.Stage ID").isin(6, 7))
    assert sorted(r["event"]["Task Info"]["Task ID"] for r in found.collect()) == sorted(
        r["event"]["Task Info"]["Task ID"] for r in wanted.collect()
    )
    # What the join lets through is all that the wide schema sees: in the plan the join stands
    # below the generator that decodes it.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    decoded, joined = plan.index("Executor Run Time"), plan.index("Join LeftSemi")
    assert decoded < joined and "Executor Run Time" not in plan[joined:]
