"""Task rows rolled up to stage, executor and job."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.constants import (
    BYTES_PER_SECTOR,
    CORES_PER_EXECUTOR,
    MILLIS_PER_JIFFY,
    SIGNIFICANT_STAGE_MS,
)

STAGE = ["app_id", "job_id", "stage_id"]
STAGE_EXECUTOR = [*STAGE, "executor_id"]
JOB = ["app_id", "job_id"]
JOB_EXECUTOR = [*JOB, "executor_id"]


def _fetched_mb() -> Column:
    return F.when(F.col("has_fetch"), F.col("remote_mb") + F.col("local_mb"))


def _sum0(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def stage_summary(job_tasks: DataFrame) -> DataFrame:
    """Times, sizes and map/reduce class of every (job, stage). Primitive buffers only."""
    return (
        job_tasks.groupBy(*STAGE)
        .agg(
            F.count(F.lit(1)).alias("n_tasks"),
            F.min("launch_ms").alias("start_ms"),
            F.max("finish_ms").alias("finish_ms"),
            F.sum("runtime_ms").alias("total_task_ms"),
            F.max("runtime_ms").alias("max_task_ms"),
            F.sum(F.col("spilled").cast("long")).alias("n_spilled"),
            _sum0(_fetched_mb()).alias("shuffle_read_mb"),
            F.sum("input_mb").alias("own_input_mb"),
            F.sum("shuffle_write_mb").alias("output_mb"),
            _sum0(F.when(F.col("has_fetch"), F.col("remote_mb"))).alias("network_mb"),
        )
        .select(
            *STAGE,
            "n_tasks",
            "start_ms",
            "finish_ms",
            (F.col("finish_ms") - F.col("start_ms")).alias("runtime_ms"),
            "total_task_ms",
            (F.col("total_task_ms") / F.col("n_tasks")).alias("mean_task_ms"),
            "max_task_ms",
            "n_spilled",
            (F.col("shuffle_read_mb") + F.col("own_input_mb")).alias("input_mb"),
            "output_mb",
            "network_mb",
            (F.col("shuffle_read_mb") > 0).alias("has_shuffle_read"),
        )
    )


def stage_input_labels(job_tasks: DataFrame) -> DataFrame:
    """Where a stage read from, by its first task in the log."""
    label = F.when(F.col("has_fetch"), "shuffle").otherwise(F.col("input_method"))
    return job_tasks.groupBy(*STAGE).agg(F.min_by(label, "pos").alias("input_label"))


def longest_tasks(job_tasks: DataFrame) -> DataFrame:
    """The longest task of every stage; the earlier one in the log on a tie."""
    task = F.struct("task_id", "executor_id", "launch_ms", "finish_ms", "runtime_ms")
    order = F.struct((-F.col("runtime_ms")).alias("longest"), F.col("pos"))
    return (
        job_tasks.groupBy(*STAGE).agg(F.min_by(task, order).alias("task")).select(*STAGE, "task.*")
    )


def job_runtimes(stages: DataFrame) -> DataFrame:
    """First start to last finish of a job, and the sum of its stage runtimes."""
    return (
        stages.groupBy(*JOB)
        .agg(
            F.count(F.lit(1)).alias("n_stages"),
            F.sum("n_tasks").alias("n_tasks"),
            F.min("start_ms").alias("start_ms"),
            F.max("finish_ms").alias("finish_ms"),
            F.sum("runtime_ms").alias("total_stage_ms"),
        )
        .withColumn("runtime_ms", F.col("finish_ms") - F.col("start_ms"))
    )


def last_significant_stage(
    stages: DataFrame, threshold_ms: int = SIGNIFICANT_STAGE_MS
) -> DataFrame:
    """Runtime of the last stage to finish among those over the threshold; -1 without one."""
    counts = F.col("runtime_ms") > threshold_ms
    latest = F.max_by(
        F.when(counts, F.col("runtime_ms")),
        F.when(counts, F.struct("finish_ms", (-F.col("stage_id")).alias("first_of_equal"))),
    )
    return stages.groupBy(*JOB).agg(
        F.coalesce(latest, F.lit(-1).cast("long")).alias("last_stage_runtime_ms")
    )


def load_balance(job_tasks: DataFrame) -> DataFrame:
    """Stage runtime over the mean busy span of its executors (floored to whole ms)."""
    spans = job_tasks.groupBy(*STAGE_EXECUTOR).agg(
        F.min("launch_ms").alias("first_ms"), F.max("finish_ms").alias("last_ms")
    )
    return (
        spans.groupBy(*STAGE)
        .agg(
            (F.max("last_ms") - F.min("first_ms")).alias("runtime_ms"),
            F.sum(F.col("last_ms") - F.col("first_ms")).alias("span_ms"),
            F.count(F.lit(1)).alias("n_executors"),
        )
        .withColumn("ideal_ms", F.floor(F.col("span_ms") / F.col("n_executors")))
        .withColumn("badness", F.try_divide(F.col("runtime_ms"), F.col("ideal_ms")))
    )


def executor_hosts(tasks: DataFrame) -> DataFrame:
    """Host of every executor, from its last task in the log."""
    return tasks.groupBy("app_id", "executor_id").agg(F.max_by("host", "pos").alias("host"))


FIRST_TASK = ["launch_ms", "start_cpu_jiffies", "start_tx_idle_ms", "start_tx_bytes", "start_gc_total"]
LAST_TASK = ["finish_ms", "end_cpu_jiffies", "end_tx_idle_ms", "end_tx_bytes", "end_gc_total", "host"]


def _counter_deltas() -> Column:
    """Disk counters between the first and the last task, for the first task's disks."""

    def delta(start: Column, end: Column, field: str) -> Column:
        last = F.when(end.isNotNull(), F.coalesce(end["End Counters"][field], F.lit(0)))
        return last - F.coalesce(start["Start Counters"][field], F.lit(0))

    def one_disk(entry: Column) -> Column:
        start, end = entry["value"], F.col("last.disks")[entry["key"]]
        read = delta(start, end, "Sectors Read") * BYTES_PER_SECTOR
        written = delta(start, end, "Sectors Written") * BYTES_PER_SECTOR
        busy = delta(start, end, "Millis Total")
        return F.struct(
            entry["key"].alias("disk"),
            read.alias("bytes_read"),
            written.alias("bytes_written"),
            delta(start, end, "Millis Reading").alias("millis_reading"),
            delta(start, end, "Millis Writing").alias("millis_writing"),
            busy.alias("millis_total"),
            F.when(busy == 0, 0.0)
            .otherwise((read + written) / F.nullif(busy, F.lit(0)) * 1000)
            .alias("effective_Bps"),
        )

    return F.transform(F.map_entries("first.disks"), one_disk)


def executor_stage_metrics(
    job_tasks: DataFrame, disks: bool = True, cores: int = CORES_PER_EXECUTOR
) -> DataFrame:
    """Resources an executor used while a stage ran on it, from OS counter differences.

    The window goes from the earliest launch (first in the log on a tie) to the latest finish
    (last in the log on a tie). Both ends come out of one combinable aggregate, so a stage with
    very many tasks only sends partial results. Without `disks` the counter maps are not read.
    """
    counters = ["disks"] if disks else []
    first, last = F.struct(*FIRST_TASK, *counters), F.struct(*LAST_TASK, *counters)
    picked = job_tasks.groupBy(*STAGE_EXECUTOR).agg(
        F.min_by(first, F.struct("launch_ms", "pos")).alias("first"),
        F.max_by(last, F.struct("finish_ms", "pos")).alias("last"),
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum("hdfs_deser_ms").alias("hdfs_deser_ms"),
        F.sum("hdfs_ser_ms").alias("hdfs_ser_ms"),
        F.sum("compute_ms").alias("compute_ms"),
        F.sum("disk_ms").alias("disk_ms"),
        _sum0(F.when(F.col("has_fetch"), F.col("remote_mb"))).alias("network_mb"),
        _sum0(_fetched_mb()).alias("shuffle_read_mb"),
    )
    elapsed = F.col("last.finish_ms") - F.col("first.launch_ms")
    metrics = picked.select(
        *STAGE_EXECUTOR,
        F.col("last.host").alias("host"),
        F.col("first.launch_ms").alias("start_ms"),
        F.col("last.finish_ms").alias("end_ms"),
        elapsed.alias("elapsed_ms"),
        "n_tasks",
        ((F.col("last.end_cpu_jiffies") - F.col("first.start_cpu_jiffies")) * MILLIS_PER_JIFFY).alias("cpu_ms"),
        "hdfs_deser_ms",
        "hdfs_ser_ms",
        (F.col("last.end_tx_bytes") - F.col("first.start_tx_bytes")).alias("tx_bytes"),
        (F.col("last.end_tx_idle_ms") - F.col("first.start_tx_idle_ms")).alias("tx_idle_ms"),
        (F.col("last.end_gc_total") - F.col("first.start_gc_total")).alias("gc_ms"),
        "compute_ms",
        "disk_ms",
        "network_mb",
        "shuffle_read_mb",
        *([_counter_deltas().alias("disks")] if disks else []),
    ).withColumn("tx_active_ms", F.col("elapsed_ms") - F.col("tx_idle_ms"))
    return _with_ratios(metrics, cores)


def _with_ratios(metrics: DataFrame, cores: int) -> DataFrame:
    return (
        metrics.withColumn(
            "cpu_utilization", F.try_divide(F.col("cpu_ms"), F.col("elapsed_ms") * cores)
        )
        .withColumn("tx_utilization", F.try_divide(F.col("tx_active_ms"), F.col("elapsed_ms")))
        .withColumn(
            "tx_effective_Bps", F.try_divide(F.col("tx_bytes"), F.col("tx_active_ms")) * 1000
        )
    )


DISK_SUMS = ["bytes_read", "bytes_written", "millis_reading", "millis_writing", "millis_total"]


def executor_stage_disks(metrics: DataFrame) -> DataFrame:
    """One row per disk of an executor's stage window."""
    return metrics.select(
        *STAGE_EXECUTOR, "elapsed_ms", F.explode("disks").alias("d")
    ).select(
        *STAGE_EXECUTOR,
        "elapsed_ms",
        "d.disk",
        *[F.col(f"d.{c}").alias(c) for c in DISK_SUMS],
        F.try_divide("d.millis_total", "elapsed_ms").alias("utilization"),
        F.col("d.effective_Bps").alias("effective_Bps"),
    )


def executor_job_metrics(metrics: DataFrame, cores: int = CORES_PER_EXECUTOR) -> DataFrame:
    """Stage windows of an executor added up per job; ratios come from the sums.

    Stages that overlap in time are counted twice in `elapsed_ms`.
    """
    summed = metrics.groupBy(*JOB_EXECUTOR).agg(
        F.max_by("host", F.struct("end_ms", "stage_id")).alias("host"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        *[
            F.sum(c).alias(c)
            for c in (
                "elapsed_ms", "n_tasks", "cpu_ms", "hdfs_deser_ms", "hdfs_ser_ms", "tx_bytes",
                "tx_idle_ms", "tx_active_ms", "gc_ms",
            )
        ],
    )
    return _with_ratios(summed, cores)


def executor_job_disks(stage_disks: DataFrame) -> DataFrame:
    """Disk windows of an executor added up per job, over the union of its disks."""
    busy, moved = F.col("millis_total"), F.col("bytes_read") + F.col("bytes_written")
    return (
        stage_disks.groupBy(*JOB_EXECUTOR, "disk")
        .agg(F.sum("elapsed_ms").alias("elapsed_ms"), *[F.sum(c).alias(c) for c in DISK_SUMS])
        .withColumn("utilization", F.try_divide("millis_total", "elapsed_ms"))
        .withColumn(
            "effective_Bps",
            F.when(busy == 0, 0.0).otherwise(moved / F.nullif(busy, F.lit(0)) * 1000),
        )
    )
