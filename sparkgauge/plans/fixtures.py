"""Log-shaped tables derived from the given tables, so that operators can be checked with SQL.

The expressions are plain SQL that Spark and DuckDB read alike; `oracle.py` puts the same
texts into its queries. Only the *inputs* are shared, never a result.
"""

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge import schemas
from sparkgauge.operators.tasks import task_columns
from sparkgauge.session import materialize, run_dir

# Helper columns over lineitem.
BASE = {
    "q": "CAST(floor(l_quantity) AS BIGINT)",
    "tax100": "CAST(round(l_tax * 100) AS BIGINT)",
    "disc100": "CAST(round(l_discount * 100) AS BIGINT)",
    "dur_ms": "50 * (1 + CAST(floor(l_extendedprice) AS BIGINT) % 100)",
    "app_no": "CAST(floor(l_orderkey / CAST(60 AS DOUBLE)) AS BIGINT) % 6",
    "stage_id": "l_orderkey % 60",
    "exec_no": "l_suppkey % 5",
    "line": "CAST(l_linenumber AS BIGINT)",
    "launch_ms": "(l_orderkey % 60) * 40000 + 100 * ((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 5) % 600)",
    "odd": "l_orderkey % 2",
}

# The order of the log: finish time, then columns that make it total.
LOG_ORDER = ["finish_ms", "launch_ms", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

# Raw event fields over the helper columns (NULL = the key is absent from the event).
RAW = {
    "task_id": "l_orderkey * 8 + line",
    "executor_id": "CAST(exec_no AS STRING)",
    "host": "concat('host-', CAST(exec_no AS STRING))",
    "locality": "CASE WHEN line % 3 = 0 THEN 'NODE_LOCAL' WHEN line % 3 = 1 THEN 'PROCESS_LOCAL' ELSE 'ANY' END",
    "run_ms": "dur_ms - disc100 - tax100 - line",
    "deser_ms": "disc100",
    "ser_ms": "tax100",
    "gc": "tax100",
    "gc_total": "finish_ms * 4 + tax100",
    "compute_ns": "CASE WHEN stage_id % 4 < 2 THEN dur_ms * 500000 END",
    "disk_ns": "CASE WHEN line % 2 = 1 THEN dur_ms * 300000 END",
    "spill": "CASE WHEN disc100 = 0 THEN q * 10 END",
    "start_idle": "launch_ms / CAST(4 AS DOUBLE)",
    "end_idle": "finish_ms / CAST(4 AS DOUBLE)",
    "start_tx": "launch_ms * 1000 * (1 + exec_no)",
    "end_tx": "finish_ms * 1000 * (1 + exec_no)",
    "tx_rate": "CAST(dur_ms * 10000 * (1 + exec_no) AS DOUBLE)",
    "rx_rate": "CAST(dur_ms * 8000 * (1 + disc100) AS DOUBLE)",
    "user_util": "(1 + tax100) / CAST(2 AS DOUBLE)",
    "sys_util": "(1 + disc100) / CAST(4 AS DOUBLE)",
    "all_user_util": "(2 + tax100) / CAST(2 AS DOUBLE)",
    "all_sys_util": "(2 + disc100) / CAST(4 AS DOUBLE)",
    "start_user_jiffies": "CAST(floor(launch_ms * (3 + exec_no) / CAST(10 AS DOUBLE)) AS BIGINT)",
    "start_sys_jiffies": "CAST(floor(launch_ms / CAST(20 AS DOUBLE)) AS BIGINT)",
    "end_user_jiffies": "CAST(floor(finish_ms * (3 + exec_no) / CAST(10 AS DOUBLE)) AS BIGINT)",
    "end_sys_jiffies": "CAST(floor(finish_ms / CAST(20 AS DOUBLE)) AS BIGINT)",
    "hdfs_deser": "CASE WHEN odd = 0 THEN disc100 * CAST(10 AS DOUBLE) END",
    "hdfs_ser": "CASE WHEN odd = 0 THEN tax100 * CAST(5 AS DOUBLE) END",
    "sw_write_ns": "CASE WHEN odd = 0 THEN dur_ms * 100000 END",
    "sw_open_ns": "CASE WHEN odd = 0 AND line > 2 THEN tax100 * 1000000 END",
    "sw_close_ns": "CASE WHEN odd = 0 AND line > 4 THEN disc100 * 500000 END",
    "sw_bytes": "CASE WHEN odd = 0 THEN q * 32768 END",
    "in_read_ns": "CASE WHEN odd = 0 AND line % 2 = 1 THEN dur_ms * 200000 END",
    "in_method": "CASE WHEN odd = 0 THEN CASE WHEN disc100 % 3 = 0 THEN 'Hadoop' WHEN disc100 % 3 = 1 THEN 'Disk' ELSE 'Memory' END END",
    "in_hadoop_bytes": "CASE WHEN odd = 0 AND line % 3 > 0 THEN q * 70000 END",
    "in_bytes": "CASE WHEN odd = 0 THEN q * 65536 END",
    "out_write_ns": "CASE WHEN odd = 1 THEN dur_ms * 1000 END",
    "out_bytes": "CASE WHEN odd = 1 AND tax100 > 0 THEN q * 1000 END",
    "block_a": "CASE WHEN odd = 1 AND (tax100 = 0 OR disc100 = 5) THEN q * 2048 END",
    "block_b": "CASE WHEN odd = 1 AND (tax100 = 0 OR disc100 = 5) THEN disc100 * 4096 END",
    "fetch_wait": "CASE WHEN odd = 1 THEN disc100 * 3 END",
    "fetch_local_blocks": "CASE WHEN odd = 1 THEN tax100 END",
    "fetch_remote_blocks": "CASE WHEN odd = 1 THEN disc100 END",
    "fetch_remote_bytes": "CASE WHEN odd = 1 THEN q * 65536 END",
    "fetch_local_bytes": "CASE WHEN odd = 1 AND line > 1 THEN tax100 * 65536 END",
    "fetch_local_ns": "CASE WHEN odd = 1 AND line > 1 THEN tax100 * 1000000 END",
}

# Disks and their factor k; executor 4 has no xvdf. `ms` is the launch or finish time.
DISKS = {"xvdb": 20, "xvdc": 12, "xvdf": 8, "xvda1": 4}
DISK_COUNTERS = {
    "sectors_read": "{ms} * {k}",
    "millis_reading": "CAST(floor({ms} * {k} / CAST(80 AS DOUBLE)) AS BIGINT)",
    "sectors_written": "{ms} * ({k} - 4)",
    "millis_writing": "CAST(floor({ms} * ({k} - 4) / CAST(80 AS DOUBLE)) AS BIGINT)",
    "millis_total": "CAST(floor({ms} * {k} / CAST(40 AS DOUBLE)) AS BIGINT)",
}
DISK_RATES = {
    "utilization": "{k} * (1 + disc100) / CAST(1000 AS DOUBLE)",
    "read_Bps": "CAST(dur_ms * {k} * 100 AS DOUBLE)",
    "write_Bps": "CAST(dur_ms * ({k} - 4) * 50 AS DOUBLE)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DEALT_ROWS = 200000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key to all shuffle partitions, as one row takes long to derive from. More
    parts where one would have over DEALT_ROWS rows, so that a sort of wide rows fits in memory."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, ceil(df.count() / DEALT_ROWS)), *keys)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
APP_ID = "concat('app-', CAST(app_no AS STRING))"


def _timed(lineitem: DataFrame, *more: str) -> DataFrame:
    """lineitem's key columns with the helper columns; `more` columns stay."""
    base = lineitem.selectExpr(
        *more, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[f"{text} AS {name}" for name, text in BASE.items()],
    )
    return base.selectExpr("*", "launch_ms + dur_ms AS finish_ms")


def _raw(timed: DataFrame, *more: str) -> DataFrame:
    return timed.selectExpr(
        *more,
        f"{APP_ID} AS app_id",
        f"struct({', '.join(LOG_ORDER)}) AS pos",
        "stage_id", "launch_ms", "finish_ms", "dur_ms", "disc100", "exec_no",
        *[f"{text} AS {name}" for name, text in RAW.items()],
    )


def raw_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row of raw event fields per lineitem row."""
    return _raw(_timed(dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")))


def _disk_list() -> Column:
    """One map per disk, as in the log. Executor 4 has no xvdf."""

    def usage(factor: int) -> Column:
        k = F.lit(factor).cast("bigint")

        def counters(ms: str) -> Column:
            half = [k * F.col(ms) / F.lit(80.0), (k - 4) * F.col(ms) / F.lit(80.0)]
            values = [
                F.col(ms) * k,
                F.floor(half[0]),
                F.col(ms) * (k - 4),
                F.floor(half[1]),
                F.floor(F.col(ms) * k / F.lit(40.0)),
            ]
            keys = schemas.DISK_COUNTERS.fieldNames()
            return F.struct(*[value.alias(key) for key, value in zip(keys, values)])

        return F.struct(
            (k * (1 + F.col("disc100")) / F.lit(1000.0)).alias("Disk Utilization"),
            (F.col("dur_ms") * k * 100).cast("double").alias("Read Throughput"),
            (F.col("dur_ms") * (k - 4) * 50).cast("double").alias("Write Throughput"),
            counters("launch_ms").alias("Start Counters"),
            counters("finish_ms").alias("End Counters"),
        )

    def listed(*names: str) -> Column:
        return F.array(*[F.create_map(F.lit(name), usage(DISKS[name])) for name in names])

    # No lambda over a whole list, which would be interpreted row by row; but one over a number, so
    # that the columns are compiled apart. All in one method they are too many for the JVM to compile.
    has_all = F.exists(F.array("exec_no"), lambda n: n != 4)
    rest = F.when(has_all, listed("xvdf", "xvda1")).otherwise(listed("xvda1"))
    return F.concat(listed("xvdb", "xvdc"), rest)


def task_end_events(raw: DataFrame, *more: str) -> DataFrame:
    """(app_id, pos, event) with the event in the shape the log source decodes; `more` columns stay."""
    c = F.col

    def struct(keys: dict[str, str]) -> Column:
        return F.struct(*[c(name).alias(key) for key, name in keys.items()])

    metrics = F.struct(
        c("run_ms").alias("Executor Run Time"),
        c("deser_ms").alias("Executor Deserialize Time"),
        F.lit(None).cast("bigint").alias("Executor CPU Time"),
        c("ser_ms").alias("Result Serialization Time"),
        c("gc").alias("JVM GC Time"),
        c("gc_total").alias("JVM GC Time Total"),
        c("disk_ns").alias("Disk Nanos"),
        c("compute_ns").alias("Computation Nanos"),
        c("spill").alias("Disk Bytes Spilled"),
        F.struct(_disk_list().alias("Device Name To Utilization")).alias("Disk Utilization"),
        c("start_idle").alias("Start Network Transmit Total Idle Millis"),
        c("end_idle").alias("End Network Transmit Total Idle Millis"),
        F.struct(
            struct({"Transmitted Bytes": "start_tx"}).alias("Start Counters"),
            struct({"Transmitted Bytes": "end_tx"}).alias("End Counters"),
            c("tx_rate").alias("Bytes Transmitted Per Second"),
            c("rx_rate").alias("Bytes Received Per Second"),
        ).alias("Network Utilization"),
        F.struct(
            c("user_util").alias("Process User Utilization"),
            c("sys_util").alias("Process System Utilization"),
            c("all_user_util").alias("Total User Utilization"),
            c("all_sys_util").alias("Total System Utilization"),
            struct({
                "Total User Jiffies": "start_user_jiffies",
                "Total System Jiffies": "start_sys_jiffies",
                "Time Milliseconds": "launch_ms",
            }).alias("Start Counters"),
            struct({
                "Total User Jiffies": "end_user_jiffies",
                "Total System Jiffies": "end_sys_jiffies",
                "Time Milliseconds": "finish_ms",
            }).alias("End Counters"),
        ).alias("Cpu Utilization"),
        c("hdfs_deser").alias("HDFS Deserialization/Decompression Millis"),
        c("hdfs_ser").alias("HDFS Serialization/Compression Millis"),
        F.when(c("sw_write_ns").isNotNull(), struct({
            "Shuffle Write Time": "sw_write_ns",
            "Shuffle Open Time": "sw_open_ns",
            "Shuffle Close Time": "sw_close_ns",
            "Shuffle Bytes Written": "sw_bytes",
        })).alias("Shuffle Write Metrics"),
        F.when(c("in_method").isNotNull(), struct({
            "Read Time Nanos": "in_read_ns",
            "Data Read Method": "in_method",
            "Hadoop Bytes Read": "in_hadoop_bytes",
            "Bytes Read": "in_bytes",
        })).alias("Input Metrics"),
        c("out_write_ns").alias("Output Write Blocked Nanos"),
        c("out_bytes").alias("Output Bytes"),
        F.when(c("block_a").isNotNull(), F.array(*[
            F.struct(struct({"Memory Size": name}).alias("Status")) for name in ("block_a", "block_b")
        ])).alias("Updated Blocks"),
        F.when(c("fetch_wait").isNotNull(), struct({
            "Fetch Wait Time": "fetch_wait",
            "Local Blocks Fetched": "fetch_local_blocks",
            "Remote Blocks Fetched": "fetch_remote_blocks",
            "Remote Bytes Read": "fetch_remote_bytes",
            "Local Bytes Read": "fetch_local_bytes",
            "Local Read Time": "fetch_local_ns",
        })).alias("Shuffle Read Metrics"),
    )
    info = F.struct(
        c("task_id").alias("Task ID"),
        c("launch_ms").alias("Launch Time"),
        c("finish_ms").alias("Finish Time"),
        c("host").alias("Host"),
        c("executor_id").alias("Executor ID"),
        c("locality").alias("Locality"),
        F.lit(False).alias("Failed"),
        F.lit(False).alias("Speculative"),
    )
    event = F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"),
        c("stage_id").alias("Stage ID"),
        info.alias("Task Info"),
        metrics.alias("Task Metrics"),
    )
    return raw.select(*more, "app_id", "pos", event.alias("event"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task table straight from the raw fields."""
    flat = raw_tasks(spark, sf_dir).select(
        "*",
        _disk_list().alias("disk_list"),
        F.when(F.col("block_a").isNotNull(), F.array("block_a", "block_b")).alias("block_sizes"),
        F.col("fetch_wait").isNotNull().alias("fetch_section"),
        F.lit(False).alias("failed"),
        F.lit(None).cast("bigint").alias("cpu_ns"),
        F.col("launch_ms").alias("start_cpu_ms"),
        F.col("finish_ms").alias("end_cpu_ms"),
    )
    return task_columns(flat)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, pos, value): the events as JSON text lines, like a log's.

    The text is many times the rows it is made from, so it is made where it is read and never
    written. Made inside an array, it is made once for all that look at it.
    """
    events = task_end_events(raw_tasks(spark, sf_dir))
    return events.select("app_id", "pos", F.explode(F.array(F.to_json("event"))).alias("value"))


# A job lists its own map and reduce stage and, if any, the reduce stage of the job before.
OWN_STAGE = "NOT (stage_id % 2 = 1 AND CAST(floor(stage_id / CAST(2 AS DOUBLE)) AS BIGINT) % 5 = 0)"
REUSED_STAGE = "stage_id % 2 = 1 AND stage_id < 59"
OWN_JOB = "CAST(floor(stage_id / CAST(2 AS DOUBLE)) AS BIGINT)"
JOB_PERIOD_MS = 80000


def job_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, job_id, stage_id, pos): a job start sorts before a task end at the same instant."""
    stages = (
        table(spark, sf_dir, "lineitem")
        .selectExpr(f"{BASE['app_no']} AS app_no", f"{BASE['stage_id']} AS stage_id")
        .distinct()
        .selectExpr("concat('app-', CAST(app_no AS STRING)) AS app_id", "stage_id", f"{OWN_JOB} AS own")
    )
    listed = F.array_compact(F.array(
        F.when(F.expr(OWN_STAGE), F.col("own")),
        F.when(F.expr(REUSED_STAGE), F.col("own") + 1),
    ))
    pairs = stages.select("app_id", "stage_id", F.explode(listed).alias("job_id"))
    start = (F.col("job_id") * JOB_PERIOD_MS).alias("finish_ms")
    low = F.lit(-1).cast("long")
    pos = F.struct(
        start, *[low.alias(name) for name in LOG_ORDER[1:-1]], F.lit(-1).cast("int").alias(LOG_ORDER[-1])
    )
    # A table, so that the planner knows how small it is before it joins tasks to it.
    return materialize(pairs.select("app_id", "job_id", "stage_id", pos.alias("pos")), "job_stages")


# What an application's number stands for in the experiment reports.
QUERY_OF_APP = "CASE WHEN app_no % 3 = 0 THEN '1a' WHEN app_no % 3 = 1 THEN '3B' ELSE '4' END"
BRANCH_OF_APP = "CASE WHEN app_no < 3 THEN 'left' ELSE 'right' END"
APP_NO = "CAST(substr(app_id, 5) AS BIGINT)"


def with_app_no(df: DataFrame) -> DataFrame:
    return df.withColumn("app_no", F.expr(APP_NO))


# Directories of runs, as experiments name them: what a run was started with, by application.
FOLDERS = {
    "sort": "concat('file:/runs/a_b_', CAST(100 * (1 + app_no % 3) AS STRING), '_d_', CAST(9 - app_no AS STRING), '_', CAST(10 * (1 + app_no % 2) AS STRING), '_x')",
    "sweep": "concat('file:/runs/experiment_log_', CAST(7 * (app_no + 1) AS STRING), '_x')",
    "systems": f"concat('file:/runs/', {BRANCH_OF_APP}, '/experiment_log_20_', CAST(100 * (1 + app_no % 3) AS STRING), '_x')",
    "disk": "concat('file:/runs/experiment_log_disk_', CAST(1 + app_no % 4 AS STRING), '_', CAST(app_no AS STRING))",
    "benchmark": f"concat('file:/results/', {QUERY_OF_APP}, '/', {BRANCH_OF_APP})",
}


def in_folders(df: DataFrame, kind: str) -> DataFrame:
    """`df` with the directory of each application's log as its id."""
    return with_app_no(df).withColumn("app_id", F.expr(FOLDERS[kind])).drop("app_no")


def _renamed(spark: SparkSession, folder: str, name_of) -> str:
    """Give the part files below `folder` the names of a log: name_of(partition values)."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = files(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listFiles(files(folder), True)
    parts = []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("part-"):
            parts.append(path)
    for path in parts:
        values = dict(x.split("=", 1) for x in path.toString().split("/") if "=" in x)
        target = files(f"{folder}/{name_of(values)}")
        system.mkdirs(target.getParent())
        system.rename(path, target)
    return folder


ROLL_LINES = 500000


def event_files(spark: SparkSession, sf_dir: str, rolls: int = 3) -> str:
    """A folder of event logs: a directory for each application, with rolled, compressed files.

    At least `rolls` files a log, more where one would have over about ROLL_LINES lines. Rows are
    dealt and sorted as they are in lineitem; the text is made where it is written.
    """
    lineitem = table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    timed = _timed(lineitem, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    total, last = timed.agg(F.count(F.lit(1)), F.max("finish_ms")).first()
    rolls = max(rolls, ceil(total / (6 * ROLL_LINES)))
    roll = (1 + F.floor(F.col("finish_ms") * rolls / F.lit((last or 0) + 1))).cast("int")
    placed = (
        timed.select(F.expr(APP_ID).alias("app"), roll.alias("roll"), "finish_ms", "launch_ms", *LINE_COLUMNS)
        .repartition(rolls * 6, "app", "roll")
        .sortWithinPartitions("app", "roll", *LOG_ORDER)
    )
    events = task_end_events(_raw(_timed(placed, "app", "roll"), "app", "roll"), "app", "roll")
    folder = f"{run_dir(spark)}/event-files-{uuid.uuid4().hex}"
    (
        events.select("app", "roll", F.to_json("event").alias("value"))
        .write.partitionBy("app", "roll")
        .option("compression", "gzip")
        .text(folder)
    )
    return _renamed(
        spark, folder, lambda v: f"eventlog_v2_{v['app']}/events_{v['roll']}_{v['app']}.gz"
    )


# --- monitor samples from events -----------------------------------------------------------

MONITOR = {
    "host": "concat('monitor-', CAST(user_id % 5 AS STRING))",
    "cpu_user": "value / CAST(100 AS DOUBLE)",
    "cpu_sys": "value / CAST(400 AS DOUBLE)",
    "rx": "CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) ELSE value * 1000 END",
    "tx": "CASE WHEN event_type = 'signup' AND k % 10 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value * 700 END",
    "total_started": "CASE WHEN k % 7 <> 0 THEN k END",
    "compute": "CASE WHEN event_type = 'view' THEN k % 9 END",
    "running": "k % 8",
    "gc_part": "CASE WHEN event_type = 'click' THEN k / CAST(100 AS DOUBLE) END",
    "outstanding": "k * 300000",
    "free_heap": "k * 10000000",
    "free_off_heap": "CASE WHEN event_type <> 'view' THEN k * 5000000 END",
}
# disk -> (factor, in the queue list under this path or absent)
MONITOR_DISKS = {"xvdb": (3, "/mnt/xvdb"), "sda1": (2, None), "sdc": (5, "/mnt/sdc"), "ram0": (7, None)}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time in epoch millis; a time without zone counts as UTC in any session."""
    events = dealt(table(spark, sf_dir, "events"), "event_id")
    instant = "CAST(ts AS TIMESTAMP)"
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        instant = f"from_utc_timestamp({instant}, current_timezone())"
    return events.selectExpr(
        "event_id", "user_id", "event_type", "value",
        f"unix_millis({instant}) AS time_ms",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    )


def monitor_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, pos, time_ms, sample) with the sample in the shape the monitor source decodes."""
    return _samples(_events(spark, sf_dir))


def _samples(base: DataFrame, *more: str) -> DataFrame:
    c = F.col
    flat = base.selectExpr(
        *more, "event_id", "time_ms", "k", *[f"{text} AS {name}" for name, text in MONITOR.items()]
    )
    disks = F.array(*[
        F.create_map(F.lit(name), F.struct(
            (c("cpu_user") * factor).alias("Disk Utilization"),
            (c("k") * 1000.0 * factor).alias("Read Throughput"),
            (c("k") * 500.0 * factor).alias("Write Throughput"),
        ))
        for name, (factor, _) in MONITOR_DISKS.items()
    ])
    queues = F.array(*[
        F.struct(
            F.lit(path).alias("Disk Name"),
            (c("k") % 6 + factor).alias("Running And Queued Monotasks"),
            (c("k") % 4).alias("Queued Read Monotasks"),
            (c("k") % 3).alias("Queued Remove Monotasks"),
            (c("k") % 5).alias("Queued Write Monotasks"),
        )
        for factor, path in MONITOR_DISKS.values() if path
    ])
    sample = F.struct(
        c("time_ms").alias("Current Time"),
        F.struct(disks.alias("Device Name To Utilization")).alias("Disk Utilization"),
        F.struct(
            c("cpu_user").alias("Total User Utilization"), c("cpu_sys").alias("Total System Utilization")
        ).alias("Cpu Utilization"),
        F.struct(
            c("rx").alias("Bytes Received Per Second"), c("tx").alias("Bytes Transmitted Per Second")
        ).alias("Network Utilization"),
        F.when(c("k") % 2 == 0, queues).alias("Running Disk Monotasks"),
        c("compute").alias("Running Compute Monotasks"),
        c("running").alias("Running Macrotasks"),
        F.lit(None).cast("bigint").alias("Local Running Macrotasks"),
        F.lit(None).cast("bigint").alias("Macrotasks In Network"),
        F.lit(None).cast("bigint").alias("Macrotasks In Compute"),
        F.lit(None).cast("bigint").alias("Macrotasks In Disk"),
        F.lit(None).cast("bigint").alias("Running Low Priority Network Monotasks"),
        c("total_started").alias("Total Started Macrotasks"),
        c("gc_part").alias("Fraction GC Time"),
        c("outstanding").alias("Outstanding Network Bytes"),
        c("free_heap").alias("Free Heap Memory Bytes"),
        c("free_off_heap").alias("Free Off-Heap Memory Bytes"),
    )
    return flat.select(
        *more, "host", F.struct("time_ms", "event_id").alias("pos"), "time_ms", "event_id", sample.alias("sample")
    )


def monitor_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of monitor logs, one file per host.

    A file's rows are sorted as they are in events; the samples and their text are made after that.
    """
    base = _events(spark, sf_dir).withColumn("monitor", F.expr(MONITOR["host"]))
    placed = base.repartition(5, "monitor").sortWithinPartitions("monitor", "time_ms", "event_id")
    folder = f"{run_dir(spark)}/monitor-files-{uuid.uuid4().hex}"
    (
        _samples(placed, "monitor")
        .select("monitor", F.to_json("sample").alias("value"))
        .write.partitionBy("monitor")
        .text(folder)
    )
    return _renamed(spark, folder, lambda v: f"logs/{v['monitor']}_executor_monitor")


# --- small work units from events ----------------------------------------------------------

def work_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, pos, value): text lines, compute and network and others, of slowly changing stages.

    In every second line the start ends the line and has two digits too many, else three.
    """
    base = _events(spark, sf_dir)
    word = F.expr(
        "CASE WHEN event_type IN ('view', 'click') THEN 'compute' WHEN event_type = 'error' THEN 'network' "
        "WHEN event_type = 'signup' THEN 'networkNetworkResponse' ELSE 'other' END"
    )
    owner = F.expr("CAST(1 + CAST(floor(event_id / CAST(40 AS DOUBLE)) AS BIGINT) % 3 AS STRING)")
    filler = [F.lit("x")] * 20
    filler[0] = word
    filler[9] = F.col("event_id").cast("string")
    filler[12] = F.concat(owner, F.when(F.col("event_type") == "error", ")").otherwise(")}"))
    filler[15] = F.col("k").cast("string")
    last = F.col("event_id") % 2 == 0
    filler[19] = F.concat(F.col("time_ms").cast("string"), F.when(last, "12").otherwise("123 x"))
    return base.select(
        F.expr("concat('work-', CAST(user_id % 3 AS STRING))").alias("file"),
        F.col("event_id").alias("pos"),
        F.concat_ws(" ", *filler).alias("value"),
    )
