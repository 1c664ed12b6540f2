"""Directories of experiment runs, from their logs to the report."""

import pytest

from sparkgauge.operators import attribution
from sparkgauge.plans import experiments as runs_of
from sparkgauge.sources import experiments
from test_logs import job_start, task_end, write


def counters(stage, i):
    """What the models read of a task: two tasks of 1 s, one after the other, on one executor."""
    at = 10_000 * stage + 1000 * i
    ends = {"Start Counters": {"Transmitted Bytes": at}, "End Counters": {"Transmitted Bytes": at + 500}}
    return at, {"Network Utilization": ends, "Computation Nanos": 400_000_000}


def run(folder, jobs, tasks=2):
    """A log of jobs with a map and a reduce stage each."""
    events = []
    for job in range(jobs):
        events.append(job_start(job, [2 * job, 2 * job + 1]))
        for stage in (2 * job, 2 * job + 1):
            for i in range(tasks):
                at, more = counters(stage, i)
                if stage % 2:
                    more["Shuffle Read Metrics"] = {
                        "Fetch Wait Time": 1, "Local Blocks Fetched": 0, "Remote Blocks Fetched": 1,
                        "Remote Bytes Read": 2_000_000,
                    }
                events.append(task_end(100 * stage + i, stage, launch=at, finish=at + 1000, **more))
    write(folder / "event_log", events)


def test_sort_runs(spark, tmp_path):
    run(tmp_path / "a_b_100_d_9_10_x", 6)
    run(tmp_path / "a_b_200_d_8_20_x", 6, tasks=3)
    (tmp_path / "a_b_100_d_9_10_x" / "notes").write_text("no log")
    rows = runs_of.sort_runs(runs_of.load(spark, str(tmp_path), "sort")).collect()
    got = {(r["num_tasks"], r["run_order"], r["num_shuffle_values"], r["phase"]): r["actual_med_s"] for r in rows}
    assert got == {
        (100, 9, 10, "map"): 2.0, (100, 9, 10, "reduce"): 2.0, (100, 9, 10, "total"): 4.0,
        (200, 8, 20, "map"): 3.0, (200, 8, 20, "reduce"): 3.0, (200, 8, 20, "total"): 6.0,
    }
    # Jobs 1, 3 and 5 are kept of 6: the second one with a shuffle, then every other one.
    kept = {r["app_id"].rsplit("/", 1)[1] for r in rows}
    assert kept == {"a_b_100_d_9_10_x", "a_b_200_d_8_20_x"}


def test_sweep_runs(spark, tmp_path):
    for number, tasks in ((2, 4), (11, 2)):
        run(tmp_path / f"experiment_log_{number}_x", 6, tasks)
    rows = runs_of.sweep_runs(runs_of.load(spark, str(tmp_path), "sweep")).orderBy("number").collect()
    assert [(r["number"], r["num_tasks"], r["map_actual_med"]) for r in rows] == [(2, 4, 4000.0), (11, 2, 2000.0)]


def test_system_and_disk_runs(spark, tmp_path):
    for system, tasks in (("left", 2), ("right", 3)):
        run(tmp_path / "systems" / system / f"experiment_log_20_{100 * tasks}_x", 6, tasks)
    runs = runs_of.load(spark, str(tmp_path / "systems"), "systems")
    rows = {(r["system"], r["num_tasks"]): (r["n"], r["p50"]) for r in runs_of.system_runs(runs).collect()}
    # A job spans its two stages, which start 10 s apart.
    assert rows == {("left", 200): (2, 12.0), ("right", 300): (2, 13.0)}
    for threads in (1, 4):
        run(tmp_path / "disk" / f"experiment_log_q_{threads}_2020", 5)
    rows = runs_of.disk_runs(runs_of.load(spark, str(tmp_path / "disk"), "disk")).collect()
    assert sorted((r["phase"], r["threads"], r["n"]) for r in rows) == [
        ("read", 1, 2), ("read", 4, 2), ("write", 1, 2), ("write", 4, 2),
    ]


def test_benchmark_runs(spark, tmp_path):
    for query, branch, tasks in (("1a", "left", 2), ("1a", "right", 3), ("3B", "left", 2), ("3B", "right", 2), ("3B", "old", 9)):
        run(tmp_path / query / branch, 5, tasks)
    runs = runs_of.load(spark, str(tmp_path), "benchmark")
    rows = runs_of.benchmark_runs(runs, ["left", "right"], 1).collect()
    got = {(r["query"], r["branch"]): (r["n"], r["median_s"], r["incomplete_trials"]) for r in rows}
    # Two jobs make a trial of 3b: after the two of the warm-up three are left.
    assert got[("1a", "left")] == (4, 12.0, 0) and got[("1a", "right")] == (4, 13.0, 0)
    assert got[("3b", "left")] == (2, 18.0, 1)
    assert ("3b", "old") not in got
    with pytest.raises(ValueError, match="wrong"):
        runs_of.benchmark_runs(runs, ["left", "wrong"])


def test_reports_of_every_log(spark, tmp_path):
    for query in ("1a", "2b"):
        run(tmp_path / query / "left", 3)
    runs = runs_of.load(spark, str(tmp_path), "benchmark")
    jobs = attribution.distinct_jobs(runs.job_stages).join(runs.params, "app_id")
    rows = runs_of.log_reports(runs.tasks, runs.job_stages, jobs, 1).collect()
    assert {r["report"] for r in rows} == {
        "stage_resources", "job_resources", "utilizations", "ideal_stage", "ideal_job",
    }
    assert len({r["app_id"] for r in rows}) == 2
    # The first job of each log is warm-up.
    assert {r["job_id"] for r in rows if r["job_id"] is not None} == {1, 2}
    spans = {
        (r["job_id"], r["stage_id"]): r["value"]
        for r in rows
        if (r["report"], r["figure"]) == ("stage_resources", "elapsed_ms")
    }
    assert spans == {(1, 2): 2000.0, (1, 3): 2000.0, (2, 4): 2000.0, (2, 5): 2000.0}


def test_runs_that_name_nothing(spark):
    runs = spark.createDataFrame([("file:/r/a_b_x_d_9_10_z",), ("file:/r/a_b_1_d_9_10_z",)], "app_id string")
    params = experiments.run_params(runs, "sort")
    assert [r["app_id"] for r in experiments.unnamed_runs(params).collect()] == ["file:/r/a_b_x_d_9_10_z"]
