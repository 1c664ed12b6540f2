"""Hand-computed figures on a small log: two jobs, three stages, two executors."""

import pytest

from sparkgauge.operators import attribution, ideal, rollup
from sparkgauge.operators.tasks import tasks_from_events
from sparkgauge.plans import reports
from sparkgauge.session import materialize
from sparkgauge.sources import event_log
from test_logs import job_start, read, task_end, write

MB = 1048576


def counters(launch, finish, cpu_rate, tx_rate, disk_rate):
    """Machine counters that grow by a fixed amount per millisecond."""

    def disk(ms):
        return {
            "Sectors Read": ms * disk_rate,
            "Millis Reading": ms // 4,
            "Sectors Written": ms * disk_rate,
            "Millis Writing": ms // 4,
            "Millis Total": ms // 2,
        }

    def jiffies(ms):
        return {"Total User Jiffies": ms * cpu_rate // 10, "Total System Jiffies": 0, "Time Milliseconds": ms}

    usage = {"Disk Utilization": 0.5, "Read Throughput": 1.0, "Write Throughput": 2.0}
    return {
        "Cpu Utilization": {
            "Process User Utilization": 1.0,
            "Process System Utilization": 0.5,
            "Total User Utilization": 2.0,
            "Total System Utilization": 1.0,
            "Start Counters": jiffies(launch),
            "End Counters": jiffies(finish),
        },
        "Network Utilization": {
            "Start Counters": {"Transmitted Bytes": launch * tx_rate},
            "End Counters": {"Transmitted Bytes": finish * tx_rate},
            "Bytes Transmitted Per Second": 1e6,
            "Bytes Received Per Second": 2e6,
        },
        "Disk Utilization": {
            "Device Name To Utilization": [
                {"xvdb": {**usage, "Start Counters": disk(launch), "End Counters": disk(finish)}},
                {"xvda1": {**usage, "Start Counters": disk(launch), "End Counters": disk(finish)}},
            ]
        },
        "JVM GC Time Total": finish * 2,
    }


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    def task(n, stage, launch, finish, executor, **extra):
        return task_end(n, stage, launch, finish, executor, **{**counters(launch, finish, 4, 1000, 2), **extra})

    fetch = {
        "Shuffle Read Metrics": {
            "Fetch Wait Time": 1, "Local Blocks Fetched": 1, "Remote Blocks Fetched": 1,
            "Remote Bytes Read": 2 * MB, "Local Bytes Read": MB,
        }
    }
    hdfs = {"HDFS Deserialization/Decompression Millis": 800.0, "HDFS Serialization/Compression Millis": 0.0}
    log = write(
        tmp_path_factory.mktemp("golden") / "event_log",
        [
            job_start(0, [0, 1]),
            task(0, 0, 1000, 2000, "0", **hdfs),
            task(1, 0, 1000, 3000, "1", **hdfs),
            task(2, 0, 2000, 5000, "0", **hdfs),
            task(3, 1, 5000, 7000, "0", **fetch, **{"Computation Nanos": 1600 * 10**6}),
            task(4, 1, 5000, 6000, "1", **fetch, **{"Computation Nanos": 400 * 10**6}),
            job_start(1, [2]),
            task(5, 2, 8000, 9000, "0"),
        ],
    )
    lines = read(spark, log)
    starts = event_log.job_stages_from_events(event_log.job_start_events(lines))
    tasks = tasks_from_events(event_log.task_end_events(lines))
    job_tasks = materialize(attribution.attach_jobs(tasks, starts), "golden")
    metrics = materialize(rollup.executor_stage_metrics(job_tasks), "golden_metrics")
    return tasks, starts, job_tasks, metrics


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_executor_windows(parts):
    row = by(parts[3], "stage_id", "executor_id")[(0, "0")]
    assert (row["start_ms"], row["end_ms"], row["elapsed_ms"], row["n_tasks"]) == (1000, 5000, 4000, 2)
    assert row["cpu_ms"] == 4000 * 4 and row["cpu_utilization"] == 0.5
    assert row["tx_bytes"] == 4_000_000 and row["tx_effective_Bps"] == 1_000_000
    # GC grows by 2 per ms; the first task's own GC time (7) is inside its window.
    assert row["gc_ms"] == 2 * 5000 - (2 * 2000 - 7)
    disks = {d["disk"]: d for d in row["disks"]}
    assert disks["xvdb"]["bytes_read"] == 512 * 2 * 4000 and disks["xvdb"]["millis_total"] == 2000
    assert disks["xvdb"]["effective_Bps"] == 2 * 512 * 2 * 4000 / 2000 * 1000


def test_ideal_stage(parts):
    rows = by(ideal.ideal_stage(parts[3], gbps=0.7), "job_id", "stage_id")
    first = rows[(0, 0)]
    # Executor 0: 16000 CPU ms over 4 s; executor 1: 8000 over 2 s; 2 executors of 8 cores.
    assert first["ideal_cpu_s"] == pytest.approx(24000 / (2 * 8 * 1000))
    assert first["fixed_cpu_s"] == pytest.approx(16000 / 8000)
    gibit = 1024**3 / 8
    assert first["ideal_network_s"] == pytest.approx(6_000_000 / (2 * 0.7 * gibit))
    assert first["fixed_network_s"] == pytest.approx(4_000_000 / (0.7 * gibit))
    disk_bytes = 2 * 512 * 2 * 6000
    assert first["n_disks"] == 1
    assert first["ideal_disk_s"] == pytest.approx(disk_bytes / (80e6 * 2))
    assert first["fixed_disk_s"] == pytest.approx(2.0)
    assert first["ser_deser_s"] == pytest.approx(2400 / 16000)
    assert first["disk_read_s"] == pytest.approx(disk_bytes / 2 / (80e6 * 2))
    assert first["bottleneck"] == "cpu" and first["runtime_ms"] == 4000
    second = rows[(0, 1)]
    # The tasks' own compute time wins over the OS counters where there is any.
    assert second["ideal_cpu_s"] == pytest.approx(2000 / 16000)
    assert second["fixed_cpu_s"] == pytest.approx(1600 / 8000)
    assert second["has_shuffle_read"] and not first["has_shuffle_read"]
    for row in rows.values():
        assert row["fixed_cpu_s"] >= row["ideal_cpu_s"]


def test_ideal_job_and_estimate(parts):
    stages = materialize(ideal.ideal_stage(parts[3]), "golden_stages")
    rows = {r["stage_id"]: r for r in stages.where("job_id = 0").collect()}
    job = by(ideal.ideal_job(stages), "job_id")[(0,)]
    assert job["ideal_s"] == pytest.approx(rows[0]["ideal_s"] + rows[1]["ideal_s"])
    assert job["actual_s"] == 6.0 and job["total_stage_s"] == 6.0
    assert job["fluid_s"] <= job["ideal_s"] + 1e-9
    estimate = by(ideal.what_if_in_memory(stages), "job_id")[(0,)]
    kept = (rows[0]["ideal_cpu_s"] - rows[0]["ser_deser_s"]) / rows[0]["ideal_s"]
    assert estimate["estimate_ms"] == pytest.approx(6000 - 4000 * (1 - kept))
    untouched = by(ideal.what_if_in_memory(stages), "job_id")[(1,)]
    assert untouched["estimate_ms"] == untouched["runtime_ms"] == 1000


def test_counter_checks(parts):
    checks = by(ideal.counter_checks(ideal.ideal_stage(parts[3])), "stage_id", "check")
    assert set(checks) == {(1, "cpu_ms"), (1, "network_mb")}
    cpu = checks[(1, "cpu_ms")]
    assert (cpu["base"], cpu["other"], cpu["flagged"]) == (2000.0, 12000.0, True)
    network = checks[(1, "network_mb")]
    assert (network["base"], network["other"]) == (4.0, 3_000_000 // MB)


def test_disk_models_from_task_times(parts):
    stages = ideal.ideal_stage(parts[3], disk_from_task_times=True)
    assert all(r["ideal_disk_s"] == 0 and r["fixed_disk_s"] == 0 for r in stages.collect())


def test_load_balance_floors_the_mean_span(parts):
    row = by(rollup.load_balance(parts[2]), "stage_id")[(0,)]
    assert (row["ideal_ms"], row["runtime_ms"]) == ((4000 + 2000) // 2, 4000)
    assert row["badness"] == pytest.approx(4 / 3)


def test_job_rollup_recomputes_ratios(parts):
    row = by(rollup.executor_job_metrics(parts[3]), "job_id", "executor_id")[(0, "0")]
    assert (row["elapsed_ms"], row["n_tasks"], row["cpu_ms"]) == (6000, 3, 24000)
    assert row["cpu_utilization"] == pytest.approx(24000 / (6000 * 8))


def test_last_significant_stage_defaults(parts):
    stages = rollup.stage_summary(parts[2])
    rows = by(rollup.last_significant_stage(stages), "job_id")
    assert rows[(0,)]["last_stage_runtime_ms"] == 2000 and rows[(1,)]["last_stage_runtime_ms"] == -1


def test_default_report_names_every_output(parts):
    report = reports.default_report(parts[0], parts[1])
    assert len(report) == 11
    assert report["ideal_job"].count() == 2
    assert report["utilizations"].where("measure = 'disk_utilization'").count() == 1
    assert reports.shuffle_report(parts[0], parts[1])["runtimes"].count() == 0


def test_logs_without_counters_give_nulls(spark, tmp_path):
    log = write(tmp_path / "event_log", [job_start(0, [0]), task_end(0, 0), task_end(1, 0, 2000, 2500)])
    lines = read(spark, log)
    starts = event_log.job_stages_from_events(event_log.job_start_events(lines))
    tasks = tasks_from_events(event_log.task_end_events(lines))
    stages = ideal.ideal_stage(rollup.executor_stage_metrics(attribution.attach_jobs(tasks, starts)))
    row = stages.collect()[0]
    assert row["ideal_network_s"] is None and row["ideal_disk_s"] == 0 and row["ideal_cpu_s"] == 0
    assert row["ideal_s"] == 0 and row["disk_read_s"] is None
