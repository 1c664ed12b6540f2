"""Which jobs a task belongs to, and which jobs an analysis keeps."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.operators.joins import salted_join
from sparkgauge.operators.ordered import row_numbers

JOB = ["app_id", "job_id"]
STAGE_OF_APP = ["app_id", "stage_id"]


def _gate(job_stages: DataFrame) -> tuple[DataFrame, Column]:
    starts = job_stages.select("app_id", "stage_id", "job_id", F.col("pos").alias("job_pos"))
    return starts, F.col("l.pos") > F.col("r.job_pos")


def attach_jobs(tasks: DataFrame, job_stages: DataFrame, salts: int | None = None) -> DataFrame:
    """Every (job, task) pair: the job lists the task's stage and started before it in the log.

    A task of a shared stage appears once per such job.
    """
    starts, gate = _gate(job_stages)
    return salted_join(
        tasks, starts, STAGE_OF_APP, ["pos"], condition=gate, salts=salts
    ).drop("job_pos")


def orphan_tasks(tasks: DataFrame, job_stages: DataFrame, salts: int | None = None) -> DataFrame:
    """Tasks that no started job lists: the quarantine."""
    starts, gate = _gate(job_stages)
    return salted_join(
        tasks, starts, STAGE_OF_APP, ["pos"], how="left_anti", condition=gate, salts=salts
    )


def keep_jobs(job_stages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Restrict the job-stage table to some jobs, before tasks are joined to it."""
    return job_stages.join(jobs.select(*JOB).distinct(), JOB, "left_semi")


def filter_jobs(
    job_stages: DataFrame, job_filter: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Apply a caller's DataFrame -> DataFrame filter to the whole job set."""
    return keep_jobs(job_stages, distinct_jobs(job_stages).transform(job_filter))


def distinct_jobs(job_stages: DataFrame) -> DataFrame:
    return job_stages.select(*JOB).distinct()


def ranked_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with their 1-based rank by id inside the application."""
    return row_numbers(jobs, ["app_id"], ["job_id"], "job_rank")


def jobs_strided(jobs: DataFrame, start: int, step: int = 2) -> DataFrame:
    """Slice [start::step] of the jobs sorted by id."""
    index = F.col("job_rank") - 1
    return ranked_jobs(jobs).where((index >= start) & ((index - start) % step == 0))


def jobs_after_setup(jobs: DataFrame) -> DataFrame:
    """Task-count sweep: three leading jobs go, then every other job is a clean-up job."""
    return jobs_strided(jobs, 3)


def jobs_after_warmup_trials(jobs: DataFrame, warmup_trials: int = 0) -> DataFrame:
    """Two-system sweep: a generator job, then pairs of (clean-up job, measured job)."""
    return jobs_strided(jobs, 2 + 2 * warmup_trials)


def is_two_job_query(query: Column) -> Column:
    return query.rlike("[34]")


def jobs_without_warmup(jobs_with_query: DataFrame, warmup_trials: int) -> DataFrame:
    """Drop the first jobs of each application: two per trial where a trial is two jobs."""
    dropped = F.when(is_two_job_query(F.col("query")), 2 * warmup_trials).otherwise(warmup_trials)
    return (
        ranked_jobs(jobs_with_query)
        .where(F.col("job_rank") > dropped)
        .withColumn("trial_rank", F.col("job_rank") - dropped)
    )


def jobs_by_phase(jobs: DataFrame, warmup: int = 0) -> DataFrame:
    """Disk-throughput runs: a generator job, then half writes, half reads, by job id."""
    counts = jobs.groupBy("app_id").agg(F.count(F.lit(1)).alias("n_jobs"))
    half = F.ceil(F.col("n_jobs") / 2.0)
    write = (F.col("job_id") > warmup) & (F.col("job_id") <= half - 1)
    read = F.col("job_id") >= half + warmup
    return (
        salted_join(jobs, counts, ["app_id"], ["job_id"])
        .withColumn("phase", F.when(write, "write").when(read, "read"))
        .where(F.col("phase").isNotNull())
        .drop("n_jobs")
    )


def small_jobs(stages: DataFrame, max_stages: int = 1, min_tasks: int = 5) -> DataFrame:
    """Jobs of at most `max_stages` stages, one of them with more than `min_tasks` tasks."""
    return (
        stages.groupBy(*JOB)
        .agg(F.count(F.lit(1)).alias("n_stages"), F.max("n_tasks").alias("max_tasks"))
        .where((F.col("n_stages") <= max_stages) & (F.col("max_tasks") > min_tasks))
    )


def shuffle_jobs(stages: DataFrame) -> DataFrame:
    """Jobs with a stage that read shuffle data."""
    return stages.where("has_shuffle_read").select(*JOB).distinct()


def second_shuffle_job(stages: DataFrame) -> DataFrame:
    """The second shuffle job of each application: (app_id, first_kept)."""
    return (
        ranked_jobs(shuffle_jobs(stages))
        .where(F.col("job_rank") == 2)
        .select("app_id", F.col("job_id").alias("first_kept"))
    )


def jobs_from_second_shuffle(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """From the second shuffle job on, every other job."""
    ranked = ranked_jobs(jobs)
    started = second_shuffle_job(stages)
    first_rank = ranked.join(
        started, (ranked.app_id == started.app_id) & (ranked.job_id == started.first_kept)
    ).select(ranked.app_id, F.col("job_rank").alias("first_rank"))
    offset = F.col("job_rank") - F.col("first_rank")
    return (
        salted_join(ranked, first_rank, ["app_id"], ["job_id"])
        .where((offset >= 0) & (offset % 2 == 0))
        .drop("first_rank")
    )


def pair_trials(runtimes: DataFrame, keys: list[str]) -> DataFrame:
    """Sum the runtimes of adjacent jobs: (keys, trial, runtime_ms, complete).

    `runtimes` has `trial_rank` (1-based). A trial with one job only is not complete.
    """
    trial = F.floor((F.col("trial_rank") - 1) / 2)
    return (
        runtimes.withColumn("trial", trial)
        .groupBy(*keys, "trial")
        .agg(
            F.sum("runtime_ms").alias("runtime_ms"),
            (F.count(F.lit(1)) == 2).alias("complete"),
        )
    )
