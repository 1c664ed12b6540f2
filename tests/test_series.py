"""Monitor files, waterfalls, experiment trees, text output and streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions.units import bits_text, bytes_text
from sparkgauge.operators import monitor, waterfall
from sparkgauge.sinks import text
from sparkgauge.operators import attribution
from sparkgauge.operators.tasks import tasks_from_events
from sparkgauge.sources import event_log, experiments, monitor_log
from sparkgauge.streaming import live
from test_logs import job_start, task_end, write


def tick(time, cpu=2.0, rx=1000.0, started=None, queue=(), disks=("xvdb",), **gauges):
    sample = {
        "Current Time": time,
        "Disk Utilization": {
            "Device Name To Utilization": [
                {d: {"Disk Utilization": 0.5, "Read Throughput": 1.0, "Write Throughput": 2.0}} for d in disks
            ]
        },
        "Cpu Utilization": {"Total User Utilization": cpu, "Total System Utilization": 1.0},
        "Network Utilization": {"Bytes Received Per Second": rx, "Bytes Transmitted Per Second": 5.0},
        "Running Disk Monotasks": [
            {
                "Disk Name": path, "Running And Queued Monotasks": n, "Queued Read Monotasks": 1,
                "Queued Remove Monotasks": 2, "Queued Write Monotasks": 3,
            }
            for path, n in queue
        ],
        **gauges,
    }
    if started is not None:
        sample["Total Started Macrotasks"] = started
    return sample


@pytest.fixture
def samples(spark, tmp_path):
    lines = [
        "Starting monitor",
        "{broken",
        tick(1000, rx="NaN", started=9),
        tick(1100, started=4, queue=[("/mnt/xvdb", 7)], disks=("xvdb", "xvda1", "ram0", "sdc", "sda1")),
        tick(1200, cpu="Infinity", started=50),
        tick(1300, started=3, **{"Outstanding Network Bytes": 3 * 1048576 - 1}),
        tick(1400, started=8),
        tick(1500),
        json.dumps(tick(1600, started=99))[:-9],
        tick(1700, started=100),
    ]
    write(tmp_path / "a_executor_monitor", lines)
    write(tmp_path / "other_file", [tick(1, started=1)])
    raw = monitor_log.read_monitor_lines(spark, str(tmp_path))
    return monitor.with_relative_time(monitor_log.whole_samples(monitor_log.decode_samples(raw)))


def test_prefix_is_skipped_and_the_first_cut_ends_the_file(samples):
    assert sorted(r["time"] for r in samples.collect()) == [0, 100, 200, 300, 400, 500]


def test_samples_and_deltas(samples):
    ticks = monitor.monitor_samples(monitor.finite_samples(samples))
    rows = {r["time"]: r for r in ticks.collect()}
    assert sorted(rows) == [100, 300, 400, 500]
    assert rows[100]["cpu_utilization"] == 3 / 8 and rows[300]["outstanding_network_mb"] == 2
    assert rows[500]["running_tasks"] == 0 and not rows[500]["has_total_started"]
    deltas = monitor.started_deltas(ticks)
    assert sorted((r["time"], r["delta"]) for r in deltas.collect()) == [(100, 4), (400, 4)]
    points = monitor.spikes(deltas).orderBy("time", "point").collect()
    assert [r["height"] for r in points] == [0, 4, 0, 0, 4, 0]


def test_disks(samples):
    rows = {(r["time"], r["disk"]): r for r in monitor.monitor_disks(monitor.finite_samples(samples)).collect()}
    assert {d for t, d in rows if t == 100} == {"xvdb", "sda1"}
    assert (rows[(100, "xvdb")]["running"], rows[(100, "xvdb")]["queued_writes"]) == (7, 3)
    assert rows[(100, "sda1")]["running"] == 0


def test_waterfall_islands(spark, tmp_path):
    def line(kind, task, owner, start, runtime):
        items = ["x"] * (20 + task % 2)
        items[0], items[9], items[12] = kind, str(task), owner
        items[15], items[19] = str(runtime), f"{start}99" if len(items) == 20 else f"{start}999"
        return " ".join(items)

    log = write(
        tmp_path / "work",
        [
            line("network", 1, "5})", 100, 3),
            line("compute", 2, "1)", 90, 20),
            line("compute", 3, "1)}", 80, 5),
            line("networkNetworkResponse", 4, "1)", 200, 1),
            line("compute", 5, "2)", 120, 1),
            line("network", 6, "7)", 110, 2),
            line("compute", 7, "1)", 130, 4),
            line("compute", 8, "1)", "soon", 4),
        ],
    )
    parsed = waterfall.parse_work_lines(waterfall.read_work_lines(spark, log))
    assert [r["id"] for r in waterfall.unreadable_work_lines(parsed).collect()] == [8]
    lanes = waterfall.waterfall(parsed)
    got = sorted((r["island"], r["lane"], r["id"], r["start"]) for r in lanes.collect())
    assert got == [(0, 0, 5, 0), (1, 0, 3, -20), (1, 1, 2, -10), (2, 0, 7, 10), (2, 1, 5, 20), (3, 0, 7, 30)]
    extent = waterfall.waterfall_extent(lanes).collect()[0]
    assert (extent["last_end"], extent["max_lanes"], extent["max_lanes_ref"]) == (34, 2, 2)


@pytest.mark.parametrize("pieces", [1, 2, 5, 9])
def test_islands_over_pieces(spark, pieces):
    """Islands of a file that is cut into pieces anywhere are those of a plain loop."""
    draw = random.Random(pieces)
    rows, wanted = [], {}
    for file in ("a", "b"):
        stage, island = 0, 0
        for pos in range(120):
            compute = draw.random() < 0.4
            own = draw.choice([0, 1, 1, 2]) if compute else None
            if compute and own != stage:
                stage, island = own, island + 1
            rows.append((file, pos, 2 if compute else 1, pos, own, 1000 + pos, 1))
            wanted[(file, pos)] = island
    parsed = spark.createDataFrame(
        rows, "file string, pos long, kind int, id long, stage_id long, start_ms long, runtime_ms long"
    )
    got = waterfall.islands(parsed, pieces=pieces).collect()
    assert {(r["file"], r["pos"]): r["island"] for r in got} == wanted


def test_experiment_tree(spark, tmp_path):
    for query, branch in (("1a", "left"), ("1a", "right"), ("3b", "left"), ("3b", "extra")):
        write(tmp_path / query / branch / "event_log", [task_end(1, 0)])
    tree = experiments.experiment_tree(experiments.list_files(spark, str(tmp_path), "event_log"))
    assert tree.count() == 4
    assert [tuple(r) for r in experiments.missing_branches(tree, ["left", "right"]).collect()] == [("3b", "right")]
    assert experiments.require_complete(tree, ["left"]).count() == 2
    with pytest.raises(ValueError, match="right of query 3b"):
        experiments.require_complete(tree, ["left", "right"])


@pytest.mark.parametrize(
    "size,as_bytes,as_bits",
    [
        (2047, "2047.00 B", "2047.00 b"),
        (2048, "2.00 KB", "2.00 Kb"),
        (-3 * 1024**2, "-3.00 MB", "-3.00 Mb"),
        (2 * 1024**3 - 1, "2048.00 MB", "2048.00 Mb"),
        (5 * 1024**4, "5.00 TB", "5.00 Tb"),
    ],
)
def test_readable_sizes(spark, size, as_bytes, as_bits):
    row = spark.range(1).select(bytes_text(F.lit(size)), bits_text(F.lit(size))).collect()[0]
    assert tuple(row) == (as_bytes, as_bits)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", 2, [])], "measure string, v long, l array<int>")
    text.write_rows(df, str(tmp_path / "out"), partition_by=["measure"])
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out"))
    assert sorted((r["measure"], r["v"], r["l"]) for r in back.collect()) == [("a", "1", "[1,2]"), ("b", "2", "[]")]
    for run_id in ("one", "two", "one"):
        text.append_rows(df.select("measure", "v"), str(tmp_path / "log"), run_id)
    back = spark.read.csv(str(tmp_path / "log"), sep="\t")
    assert sorted(r["run"] for r in back.collect()) == ["one", "one", "two", "two"]


def test_report_is_complete_or_not_there(spark, tmp_path):
    path = str(tmp_path / "reports")
    first = spark.createDataFrame([("a", [1, 2])], "k string, l array<int>")
    text.write_report({"x": first, "y": first.where("false")}, path, "r1")
    back = text.read_report(spark, path, "r1")
    assert sorted(back) == ["x", "y"] and back["y"].count() == 0
    assert [tuple(r) for r in back["x"].collect()] == [("a", [1, 2])]
    text.write_report({"x": first}, path, "r1")
    text.write_report({"x": first}, path, "r2")
    assert sorted(text.read_report(spark, path, "r1")) == ["x"]
    assert text.read_report(spark, path, "r1")["x"].count() == 1

    broken = first.select(F.raise_error(F.lit("lost")).alias("k"))
    with pytest.raises(Exception, match="lost"):
        text.write_report({"x": first, "z": broken}, path, "r1")
    with pytest.raises(ValueError, match="not complete"):
        text.read_report(spark, path, "r1")


def test_monitor_stream_equals_batch(spark, tmp_path):
    for n in range(3):
        ticks = [tick(10_000 * n + 1000 * i, cpu=float(i), rx="NaN" if i == 4 else 10.0 * i) for i in range(10)]
        write(tmp_path / "in" / f"{n}_executor_monitor", [*ticks, "{cut"])
    directory = str(tmp_path / "in")
    stream = live.utilization_windows(live.monitor_stream(spark, directory, max_files=1))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("live_windows").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    raw = monitor_log.decode_samples(monitor_log.read_monitor_lines(spark, directory)).where("ok").drop("ok")
    batch = live.utilization_windows(
        monitor.finite_samples(raw).withColumn("ts", F.timestamp_millis(F.col("sample.`Current Time`")))
    )
    assert sorted(map(tuple, spark.table("live_windows").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() == 3


def test_task_stream_appends_closed_windows(spark, tmp_path):
    events = [task_end(i, 0, 60_000 * i, 60_000 * i + 500, str(i % 2)) for i in range(30)]
    write(tmp_path / "in" / "app-1", events)
    windows = live.task_windows(live.task_stream(spark, str(tmp_path / "in")), late_by="1 minute")
    out = str(tmp_path / "out")
    for _ in range(2):
        live.append_table(windows, out, str(tmp_path / "ckpt")).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len({r["start"] for r in rows}) and 25 <= len(rows) <= 30
    assert all(r["n_tasks"] == 1 and r["task_ms"] == 500 for r in rows)


def test_streamed_tasks_find_their_jobs_like_the_batch(spark, tmp_path):
    """Four files of a rolled log, one per micro-batch; stage 1 serves two jobs, stages 7 and 8 none."""
    minute, noon = 60_000, 1_700_000_000_000
    folder = tmp_path / "in" / "eventlog_v2_a"
    files = [
        [job_start(0, [0, 1], noon), *[task_end(i, i % 2, noon, noon + minute * (2 + i)) for i in range(6)], task_end(90, 7, noon, noon + minute)],
        [job_start(1, [1, 2], noon + 10 * minute), *[task_end(10 + i, 1 + i % 2, noon, noon + minute * (11 + i)) for i in range(6)]],
        [task_end(20, 1, noon, noon + 40 * minute), task_end(91, 8, noon, noon + 41 * minute), task_end(92, 0, noon, noon + 200 * minute)],
        [job_start(2, [9], noon + 300 * minute), task_end(93, 9, noon, noon + 301 * minute)],
    ]
    for n, events in enumerate(files, 1):
        path = write(folder / f"events_{n}_a", events)
        os.utime(path, (1_700_000_000 + 60 * n,) * 2)  # a stream reads files in order of their times
    lines = event_log.read_lines(spark, str(folder))
    tasks = tasks_from_events(event_log.task_end_events(lines))
    starts = event_log.job_stages_from_events(event_log.job_start_events(lines))
    wanted = sorted((r["job_id"], r["task_id"]) for r in attribution.attach_jobs(tasks, starts).collect())
    lost = sorted(r["task_id"] for r in attribution.orphan_tasks(tasks, starts).collect())

    def streams():
        directory = f"{tmp_path}/in/*"
        return (
            live.task_stream(spark, directory, "events_*", max_files=1),
            live.job_stage_stream(spark, directory, "events_*", max_files=1),
        )

    attached = live.attach_jobs(*streams(), late_by="5 minutes", longest="3 hours")
    orphans = live.orphan_tasks(*streams(), late_by="5 minutes", longest="3 hours")
    for name, frame in (("live_jobs", attached), ("live_orphans", orphans)):
        query = frame.writeStream.outputMode("append").format("memory").queryName(name).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    got = sorted((r["job_id"], r["task_id"]) for r in spark.table("live_jobs").collect())
    # The last task is three hours after the job that lists its stage: within reach in the batch only.
    assert got == [x for x in wanted if x[1] != 92] and (0, 92) in wanted
    assert lost == [90, 91]
    assert sorted(r["task_id"] for r in spark.table("live_orphans").collect()) == [90, 91, 92]
