"""Logs that are still being written, as Structured Streaming (an extension of the batch work).

Log order does not exist across micro-batches. Windows of utilization and of finished tasks need
none. Tasks are attached to jobs by time instead: a job counts if it was submitted before the task
finished. All equal the batch results over the same lines where submission times follow log order.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.constants import BYTES_PER_GIBIT, CORES_PER_EXECUTOR
from sparkgauge.operators.monitor import finite_samples
from sparkgauge.operators.tasks import tasks_from_events
from sparkgauge.sources.event_log import job_start_events, task_end_events
from sparkgauge.sources.monitor_log import MONITOR_FILES, decode_samples


def stream_lines(
    spark: SparkSession, directory: str, pattern: str, max_files: int | None = None
) -> DataFrame:
    """(source, pos, value) of new files in a directory; `pos` is NULL in a stream."""
    reader = spark.readStream.format("text").option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(directory).select(
        F.col("_metadata.file_path").alias("source"), F.lit(None).cast("bigint").alias("pos"), "value"
    )


def monitor_stream(spark: SparkSession, directory: str, pattern: str = MONITOR_FILES, **options):
    """(host, pos, sample, ts) of whole samples with finite rates."""
    lines = stream_lines(spark, directory, pattern, **options).withColumnRenamed("source", "host")
    samples = finite_samples(decode_samples(lines).where("ok").drop("ok"))
    return samples.withColumn("ts", F.timestamp_millis(F.col("sample.`Current Time`")))


def utilization_windows(
    samples: DataFrame, length: str = "10 seconds", late_by: str = "1 minute"
) -> DataFrame:
    """Mean and peak utilization per host and tumbling window. Works on a batch frame too."""
    cpu, net = F.col("sample.`Cpu Utilization`"), F.col("sample.`Network Utilization`")
    total = (cpu["Total User Utilization"] + cpu["Total System Utilization"]) / float(CORES_PER_EXECUTOR)
    return (
        samples.withWatermark("ts", late_by)
        .groupBy(F.window("ts", length), "host")
        .agg(
            F.count(F.lit(1)).alias("ticks"),
            F.avg(total).alias("cpu_mean"),
            F.max(total).alias("cpu_peak"),
            F.avg(net["Bytes Received Per Second"] / BYTES_PER_GIBIT).alias("rx_mean"),
            F.avg(net["Bytes Transmitted Per Second"] / BYTES_PER_GIBIT).alias("tx_mean"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "host", "ticks", "cpu_mean", "cpu_peak", "rx_mean", "tx_mean")
    )


def _of_application(lines: DataFrame) -> DataFrame:
    """`app_id` as `event_log.read_lines` has it: files of a rolled log belong to their directory."""
    rolled = F.col("source").rlike("/(events_[0-9]+_[^/]*|event_log)$")
    folder = F.regexp_replace("source", "/[^/]+$", "")
    return lines.withColumn("app_id", F.when(rolled, folder).otherwise(F.col("source"))).drop("source")


def task_stream(spark: SparkSession, directory: str, pattern: str = "*", **options) -> DataFrame:
    """Task table with `ts`, the finish time."""
    lines = _of_application(stream_lines(spark, directory, pattern, **options))
    tasks = tasks_from_events(task_end_events(lines))
    return tasks.withColumn("ts", F.timestamp_millis("finish_ms"))


def task_windows(
    tasks: DataFrame, length: str = "1 minute", late_by: str = "10 minutes"
) -> DataFrame:
    """Finished tasks and their time per application, executor and tumbling window."""
    return (
        tasks.withWatermark("ts", late_by)
        .groupBy(F.window("ts", length), "app_id", "executor_id")
        .agg(
            F.count(F.lit(1)).alias("n_tasks"),
            F.sum("runtime_ms").alias("task_ms"),
            F.max("runtime_ms").alias("max_task_ms"),
        )
        .select(F.col("window.start").alias("start"), "app_id", "executor_id", "n_tasks", "task_ms", "max_task_ms")
    )


def job_stage_stream(spark: SparkSession, directory: str, pattern: str = "*", **options) -> DataFrame:
    """(app_id, job_id, stage_id, started) of the jobs that start, with their submission time."""
    lines = _of_application(stream_lines(spark, directory, pattern, **options))
    event = F.col("event")
    return job_start_events(lines).select(
        "app_id",
        event["Job ID"].alias("job_id"),
        F.explode(event["Stage IDs"]).alias("stage_id"),
        F.timestamp_millis(event["Submission Time"]).alias("started"),
    )


def _with_jobs(tasks: DataFrame, job_stages: DataFrame, how: str, late_by: str, longest: str) -> DataFrame:
    starts = job_stages.select(
        F.col("app_id").alias("job_app"), F.col("stage_id").alias("job_stage"), "job_id", "started"
    ).withWatermark("started", late_by)
    on = (
        (F.col("app_id") == F.col("job_app"))
        & (F.col("stage_id") == F.col("job_stage"))
        & (F.col("ts") > F.col("started"))
        & (F.col("ts") <= F.col("started") + F.expr(f"INTERVAL {longest}"))
    )
    return tasks.withWatermark("ts", late_by).join(starts, on, how)


def attach_jobs(
    tasks: DataFrame, job_stages: DataFrame, late_by: str = "10 minutes", longest: str = "1 day"
) -> DataFrame:
    """(job, task) pairs of two streams (`task_stream`, `job_stage_stream`); batch frames work too.

    `longest` bounds the time from a job's submission to its last task, and so the state: a start is
    forgotten after it, a task once no earlier start can come.
    """
    joined = _with_jobs(tasks, job_stages, "inner", late_by, longest)
    return joined.drop("job_app", "job_stage", "started")


def orphan_tasks(
    tasks: DataFrame, job_stages: DataFrame, late_by: str = "10 minutes", longest: str = "1 day"
) -> DataFrame:
    """Tasks that no job listed, told once the watermark has passed them: the quarantine."""
    joined = _with_jobs(tasks, job_stages, "left_outer", late_by, longest)
    return joined.where("job_id IS NULL").drop("job_app", "job_stage", "started", "job_id")


def append_table(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append closed windows to a Parquet table; exactly once through the checkpoint."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
