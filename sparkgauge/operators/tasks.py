"""Task columns: one flat row per finished task, from the decoded event."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.constants import BYTES_PER_MB, NANOS_PER_MILLI
from sparkgauge.schemas import TASK_DISK


def _no_disks() -> Column:
    return F.create_map().cast(T.MapType(T.StringType(), TASK_DISK))


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0).cast("long"))


def _or_zero_double(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0))


def _millis(nanos: Column) -> Column:
    return _or_zero_double(nanos / NANOS_PER_MILLI)


def _mb(num_bytes: Column) -> Column:
    return num_bytes / F.lit(float(BYTES_PER_MB))


def merge_maps(array_of_maps: Column, empty: Column) -> Column:
    """Fold an array of small maps to one map; a repeated key keeps its last entry."""
    entries = F.flatten(F.transform(array_of_maps, lambda one: F.map_entries(one)))
    keys = F.flatten(F.transform(array_of_maps, lambda one: F.map_keys(one)))
    last_wins = F.aggregate(
        array_of_maps,
        empty,
        lambda seen, one: F.map_concat(
            F.map_filter(seen, lambda key, _: ~F.map_contains_key(one, key)), one
        ),
    )
    no_repeats = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.coalesce(F.when(no_repeats, F.map_from_entries(entries)).otherwise(last_wins), empty)


# Where the raw fields of a task are in its event: name here -> path of keys.
_METRICS, _CPU, _NET = "Task Metrics", "Cpu Utilization", "Network Utilization"
_READ, _WRITE, _INPUT = "Shuffle Read Metrics", "Shuffle Write Metrics", "Input Metrics"
LEAVES = {
    "stage_id": ("Stage ID",),
    "task_id": ("Task Info", "Task ID"),
    "executor_id": ("Task Info", "Executor ID"),
    "host": ("Task Info", "Host"),
    "locality": ("Task Info", "Locality"),
    "failed": ("Task Info", "Failed"),
    "launch_ms": ("Task Info", "Launch Time"),
    "finish_ms": ("Task Info", "Finish Time"),
    "run_ms": (_METRICS, "Executor Run Time"),
    "deser_ms": (_METRICS, "Executor Deserialize Time"),
    "ser_ms": (_METRICS, "Result Serialization Time"),
    "gc": (_METRICS, "JVM GC Time"),
    "gc_total": (_METRICS, "JVM GC Time Total"),
    "compute_ns": (_METRICS, "Computation Nanos"),
    "cpu_ns": (_METRICS, "Executor CPU Time"),
    "disk_ns": (_METRICS, "Disk Nanos"),
    "spill": (_METRICS, "Disk Bytes Spilled"),
    "disk_list": (_METRICS, "Disk Utilization", "Device Name To Utilization"),
    "start_idle": (_METRICS, "Start Network Transmit Total Idle Millis"),
    "end_idle": (_METRICS, "End Network Transmit Total Idle Millis"),
    "start_tx": (_METRICS, _NET, "Start Counters", "Transmitted Bytes"),
    "end_tx": (_METRICS, _NET, "End Counters", "Transmitted Bytes"),
    "tx_rate": (_METRICS, _NET, "Bytes Transmitted Per Second"),
    "rx_rate": (_METRICS, _NET, "Bytes Received Per Second"),
    "user_util": (_METRICS, _CPU, "Process User Utilization"),
    "sys_util": (_METRICS, _CPU, "Process System Utilization"),
    "all_user_util": (_METRICS, _CPU, "Total User Utilization"),
    "all_sys_util": (_METRICS, _CPU, "Total System Utilization"),
    "start_user_jiffies": (_METRICS, _CPU, "Start Counters", "Total User Jiffies"),
    "start_sys_jiffies": (_METRICS, _CPU, "Start Counters", "Total System Jiffies"),
    "start_cpu_ms": (_METRICS, _CPU, "Start Counters", "Time Milliseconds"),
    "end_user_jiffies": (_METRICS, _CPU, "End Counters", "Total User Jiffies"),
    "end_sys_jiffies": (_METRICS, _CPU, "End Counters", "Total System Jiffies"),
    "end_cpu_ms": (_METRICS, _CPU, "End Counters", "Time Milliseconds"),
    "hdfs_deser": (_METRICS, "HDFS Deserialization/Decompression Millis"),
    "hdfs_ser": (_METRICS, "HDFS Serialization/Compression Millis"),
    "sw_write_ns": (_METRICS, _WRITE, "Shuffle Write Time"),
    "sw_open_ns": (_METRICS, _WRITE, "Shuffle Open Time"),
    "sw_close_ns": (_METRICS, _WRITE, "Shuffle Close Time"),
    "sw_bytes": (_METRICS, _WRITE, "Shuffle Bytes Written"),
    "in_read_ns": (_METRICS, _INPUT, "Read Time Nanos"),
    "in_method": (_METRICS, _INPUT, "Data Read Method"),
    "in_hadoop_bytes": (_METRICS, _INPUT, "Hadoop Bytes Read"),
    "in_bytes": (_METRICS, _INPUT, "Bytes Read"),
    "out_write_ns": (_METRICS, "Output Write Blocked Nanos"),
    "out_bytes": (_METRICS, "Output Bytes"),
    "fetch_wait": (_METRICS, _READ, "Fetch Wait Time"),
    "fetch_local_blocks": (_METRICS, _READ, "Local Blocks Fetched"),
    "fetch_remote_blocks": (_METRICS, _READ, "Remote Blocks Fetched"),
    "fetch_remote_bytes": (_METRICS, _READ, "Remote Bytes Read"),
    "fetch_local_bytes": (_METRICS, _READ, "Local Bytes Read"),
    "fetch_local_ns": (_METRICS, _READ, "Local Read Time"),
}


def flat_events(events: DataFrame) -> DataFrame:
    """Raw fields of (app_id, pos, event) side by side; an absent field is NULL."""

    def leaf(path: tuple[str, ...]) -> Column:
        column = F.col("event")
        for key in path:
            column = column[key]
        return column

    blocks = F.transform(
        leaf((_METRICS, "Updated Blocks")), lambda block: block["Status"]["Memory Size"]
    )
    return events.select(
        "app_id",
        "pos",
        *[leaf(path).alias(name) for name, path in LEAVES.items()],
        blocks.alias("block_sizes"),
        leaf((_METRICS, _READ)).isNotNull().alias("fetch_section"),
    )


def task_columns(
    flat: DataFrame,
    has_fetch_rule: str = "presence",
    cpu_source: str = "computation",
    success_only: bool = False,
) -> DataFrame:
    """Task table from the raw fields: units, defaults and derived times.

    `has_fetch_rule='bytes>0'` and `cpu_source='executor_cpu_time'` suit stock logs, which
    always carry a shuffle-read section and have CPU time only as one executor counter.
    """
    c = F.col
    if has_fetch_rule == "presence":
        has_fetch = c("fetch_section")
    elif has_fetch_rule == "bytes>0":
        has_fetch = _or_zero(c("fetch_remote_bytes")) + _or_zero(c("fetch_local_bytes")) > 0
    else:
        raise ValueError(f"unknown has_fetch_rule {has_fetch_rule!r}")
    compute_ns = {"computation": c("compute_ns"), "executor_cpu_time": c("cpu_ns")}[cpu_source]
    end_gc = _or_zero(c("gc_total"))
    method = F.coalesce("in_method", F.lit("unknown"))
    input_bytes = F.when(
        (method == "Hadoop") & c("in_hadoop_bytes").isNotNull(), c("in_hadoop_bytes")
    ).otherwise(c("in_bytes"))
    blocks = F.coalesce("block_sizes", F.array().cast("array<bigint>"))
    in_memory = F.exists(blocks, lambda size: size > 0)
    output_bytes = _or_zero(c("out_bytes"))
    block_bytes = F.aggregate(blocks, F.lit(0).cast("long"), lambda total, size: total + size)

    if success_only:
        flat = flat.where(~F.coalesce("failed", F.lit(False)))
    return flat.select(
        "app_id",
        "pos",
        "stage_id",
        "task_id",
        "executor_id",
        "host",
        "launch_ms",
        "finish_ms",
        (c("finish_ms") - c("launch_ms")).alias("runtime_ms"),
        c("run_ms").alias("executor_run_ms"),
        c("deser_ms").alias("executor_deser_ms"),
        c("ser_ms").alias("result_ser_ms"),
        (c("finish_ms") - c("launch_ms") - c("run_ms") - c("deser_ms") - c("ser_ms")).alias("scheduler_delay_ms"),
        c("gc").alias("gc_ms"),
        (end_gc - c("gc")).alias("start_gc_total"),
        end_gc.alias("end_gc_total"),
        _millis(compute_ns).alias("compute_ms"),
        _millis(c("disk_ns")).alias("disk_ms"),
        _or_zero(c("spill")).alias("disk_bytes_spilled"),
        (_or_zero(c("spill")) > 0).alias("spilled"),
        merge_maps(c("disk_list"), _no_disks()).alias("disks"),
        c("start_tx").alias("start_tx_bytes"),
        c("end_tx").alias("end_tx_bytes"),
        _or_zero_double(c("tx_rate")).alias("tx_Bps"),
        _or_zero_double(c("rx_rate")).alias("rx_Bps"),
        _or_zero_double(c("start_idle")).alias("start_tx_idle_ms"),
        _or_zero_double(c("end_idle")).alias("end_tx_idle_ms"),
        _or_zero_double(c("user_util")).alias("proc_user_cpu"),
        _or_zero_double(c("sys_util")).alias("proc_sys_cpu"),
        _or_zero_double(c("user_util") + c("sys_util")).alias("proc_cpu"),
        _or_zero_double(c("all_user_util") + c("all_sys_util")).alias("total_cpu"),
        _or_zero(c("start_user_jiffies") + c("start_sys_jiffies")).alias("start_cpu_jiffies"),
        _or_zero(c("end_user_jiffies") + c("end_sys_jiffies")).alias("end_cpu_jiffies"),
        _or_zero(c("start_cpu_ms")).alias("start_cpu_sample_ms"),
        _or_zero(c("end_cpu_ms")).alias("end_cpu_sample_ms"),
        _or_zero_double(c("hdfs_deser")).alias("hdfs_deser_ms"),
        _or_zero_double(c("hdfs_ser")).alias("hdfs_ser_ms"),
        (_millis(c("sw_write_ns")) + _millis(c("sw_open_ns")) + _millis(c("sw_close_ns"))).alias("shuffle_write_ms"),
        _or_zero_double(_mb(c("sw_bytes"))).alias("shuffle_write_mb"),
        _millis(c("in_read_ns")).alias("input_read_ms"),
        method.alias("input_method"),
        _or_zero_double(_mb(input_bytes)).alias("input_mb"),
        _millis(c("out_write_ns")).alias("output_write_ms"),
        (_mb(output_bytes) + _mb(block_bytes)).alias("output_mb"),
        (~in_memory).alias("output_on_disk"),
        (in_memory & (output_bytes > 0)).alias("output_conflict"),
        has_fetch.alias("has_fetch"),
        (has_fetch | F.coalesce(c("locality") == "NODE_LOCAL", F.lit(False))).alias("data_local"),
        F.when(has_fetch, c("fetch_wait")).alias("fetch_wait_ms"),
        F.when(has_fetch, c("fetch_local_blocks")).alias("local_blocks"),
        F.when(has_fetch, c("fetch_remote_blocks")).alias("remote_blocks"),
        F.when(has_fetch, _mb(c("fetch_remote_bytes"))).alias("remote_mb"),
        F.when(has_fetch, _or_zero_double(_mb(c("fetch_local_bytes")))).alias("local_mb"),
        F.when(has_fetch, _millis(c("fetch_local_ns"))).alias("local_read_ms"),
    )


def tasks_from_events(events: DataFrame, **options) -> DataFrame:
    return task_columns(flat_events(events), **options)


def with_input_size(tasks: DataFrame) -> DataFrame:
    """What the task read: from the shuffle if it fetched, else its input."""
    size = F.when(F.col("has_fetch"), F.col("remote_mb") + F.col("local_mb"))
    return tasks.withColumn("input_size_mb", size.otherwise(F.col("input_mb")))


def task_summary_text(tasks: DataFrame) -> DataFrame:
    """One readable line per task (debug view)."""
    shuffle_line = F.format_string(
        "start %d, local read %.1f ms, fetch wait %d ms, compute %.1f ms, gc %d ms, "
        "shuffle write %.1f ms, result ser %d ms, runtime %d ms, shuffle %.3f MB, input %.3f MB",
        "launch_ms", "local_read_ms", "fetch_wait_ms", "compute_ms", "gc_ms",
        "shuffle_write_ms", "result_ser_ms", "runtime_ms",
        F.col("local_mb") + F.col("remote_mb"), "input_mb",
    )
    input_line = F.format_string(
        "start %d, finish %d, scheduler delay %d ms, input read %.1f ms, gc %d ms, "
        "shuffle write %.1f ms",
        "launch_ms", "finish_ms", "scheduler_delay_ms", "input_read_ms", "gc_ms",
        "shuffle_write_ms",
    )
    text = F.when(F.col("has_fetch"), shuffle_line).otherwise(input_line)
    return tasks.select("app_id", "stage_id", "task_id", text.alias("summary"))
