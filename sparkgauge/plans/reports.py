"""Composite reports: whole analyses over many logs, one pass over the tasks each.

Reports take the task table and the job-stage table, or the small stage and job tables made
from them. What several parts of a report read is written to the shared folder once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.constants import CORES_PER_EXECUTOR, NETWORK_GBPS, NETWORK_GBPS_SORT
from sparkgauge.functions.units import ms_to_s
from sparkgauge.operators import attribution, ideal, rollup, stats, utilization
from sparkgauge.operators.ordered import row_numbers
from sparkgauge.session import materialize


def stage_models(
    tasks: DataFrame,
    job_stages: DataFrame,
    gbps: float = NETWORK_GBPS,
    cores: int = CORES_PER_EXECUTOR,
) -> DataFrame:
    """Ideal and actual times of every (job, stage): the one pass over the tasks."""
    job_tasks = attribution.attach_jobs(tasks, job_stages)
    return ideal.ideal_stage(rollup.executor_stage_metrics(job_tasks), gbps, cores)


def default_report(tasks: DataFrame, job_stages: DataFrame, rule: str = "reference") -> dict[str, DataFrame]:
    """Everything about an application's jobs, by name of the output."""
    job_tasks = materialize(attribution.attach_jobs(tasks, job_stages), "job_tasks")
    metrics = materialize(rollup.executor_stage_metrics(job_tasks), "executor_stage")
    models = materialize(ideal.ideal_stage(metrics), "stage_models")
    report = shuffle_parts(job_tasks, rule)
    report.update(
        stage_resource_metrics=metrics,
        stage_disks=rollup.executor_stage_disks(metrics),
        job_resource_metrics=rollup.executor_job_metrics(metrics),
        job_disks=rollup.executor_job_disks(rollup.executor_stage_disks(metrics)),
        ideal_stage=models,
        ideal_job=ideal.ideal_job(models),
        counter_checks=ideal.counter_checks(models),
    )
    return report


def shuffle_parts(job_tasks: DataFrame, rule: str = "reference") -> dict[str, DataFrame]:
    jobs = rollup.job_runtimes(rollup.stage_summary(job_tasks))
    return {
        "task_runtimes": stats.summary(job_tasks, ["app_id"], "runtime_ms"),
        "utilizations": utilization.utilizations(job_tasks, rule),
        "load_balance": stats.summary(rollup.load_balance(job_tasks), ["app_id"], "badness"),
        "runtimes": stats.summary(jobs, ["app_id"], "runtime_ms"),
    }


def shuffle_report(tasks: DataFrame, job_stages: DataFrame, rule: str = "reference") -> dict[str, DataFrame]:
    """Utilizations, load balance and runtimes of the small jobs."""
    job_tasks = materialize(attribution.attach_jobs(tasks, job_stages), "job_tasks")
    kept = attribution.small_jobs(rollup.stage_summary(job_tasks))
    # Rows of a job may be many: the kept jobs select from the start table, not by a shuffle
    # of the task rows on the job.
    selected = attribution.keep_jobs(job_stages, kept)
    return shuffle_parts(
        materialize(attribution.attach_jobs(tasks, selected), "small_job_tasks"), rule
    )


def _millis(seconds: str) -> Column:
    return F.col(seconds) * 1000


def sort_report(models: DataFrame, job_stages: DataFrame, keys: tuple[str, ...] = ("app_id",)) -> DataFrame:
    """Map, reduce and total times in seconds (min, median, max): actual and ideal.

    `models` is `stage_models(..., gbps=NETWORK_GBPS_SORT)`, as a table. The total of a job is
    the sum over its stages; only the total has a fluid ideal, only reduce a CPU ideal.
    """
    jobs = attribution.distinct_jobs(job_stages)
    kept = attribution.jobs_from_second_shuffle(jobs, models)
    stages = models.join(kept.select(*rollup.JOB), rollup.JOB, "left_semi")
    no_value = F.lit(None).cast("double")
    by_phase = stages.select(
        *keys,
        F.when(F.col("has_shuffle_read"), "reduce").otherwise("map").alias("phase"),
        F.col("runtime_ms").cast("double").alias("actual"),
        _millis("ideal_s").alias("ideal"),
        _millis("fixed_s").alias("fixed"),
        no_value.alias("fluid"),
        F.when(F.col("has_shuffle_read"), _millis("ideal_cpu_s")).alias("cpu"),
    )
    totals = ideal.ideal_job(stages).select(
        *keys,
        F.lit("total").alias("phase"),
        _millis("total_stage_s").alias("actual"),
        _millis("ideal_s").alias("ideal"),
        _millis("fixed_s").alias("fixed"),
        _millis("fluid_s").alias("fluid"),
        no_value.alias("cpu"),
    )
    values = ["actual", "ideal", "fixed", "fluid", "cpu"]
    wide = stats.summaries_wide(by_phase.unionByName(totals), [*keys, "phase"], values)
    return wide.select(
        *keys, "phase", *[ms_to_s(F.col(c)).alias(f"{c}_s") for c in wide.columns if c not in (*keys, "phase")]
    )


SWEEP_VALUES = [
    "actual", "ideal", "ratio", "map_actual", "map_ideal", "reduce_actual", "reduce_ideal",
]


def task_sweep_report(models: DataFrame, job_stages: DataFrame) -> DataFrame:
    """Task-count sweep, one row per application (in ms): min, median and max of actual and
    ideal job times, their ratio, and actual and ideal map and reduce stage times."""
    kept = attribution.jobs_after_setup(attribution.distinct_jobs(job_stages))
    stages = models.join(kept.select(*rollup.JOB), rollup.JOB, "left_semi")
    is_reduce = F.col("has_shuffle_read")
    stage_rows = stages.select(
        "app_id",
        *[F.lit(None).cast("double").alias(v) for v in SWEEP_VALUES[:3]],
        F.when(~is_reduce, F.col("runtime_ms").cast("double")).alias("map_actual"),
        F.when(~is_reduce, _millis("ideal_s")).alias("map_ideal"),
        F.when(is_reduce, F.col("runtime_ms").cast("double")).alias("reduce_actual"),
        F.when(is_reduce, _millis("ideal_s")).alias("reduce_ideal"),
    )
    job_rows = ideal.ideal_job(stages).select(
        "app_id",
        _millis("actual_s").alias("actual"),
        _millis("ideal_s").alias("ideal"),
        F.col("actual_over_ideal").alias("ratio"),
        *[F.lit(None).cast("double").alias(v) for v in SWEEP_VALUES[3:]],
    )
    first_stage = stages.groupBy("app_id").agg(
        F.min_by("n_tasks", F.struct("job_id", "stage_id")).alias("num_tasks")
    )
    wide = stats.summaries_wide(job_rows.unionByName(stage_rows), ["app_id"], SWEEP_VALUES)
    return first_stage.join(wide, ["app_id"])


def sweep_plot_columns(report: DataFrame) -> DataFrame:
    """Times in seconds and the relative difference of actual to ideal."""
    return report.select(
        "app_id",
        "num_tasks",
        *[
            ms_to_s(F.col(f"{v}_{s}")).alias(f"{v}_{s}_s")
            for v in SWEEP_VALUES
            if v != "ratio"
            for s in ("min", "med", "max")
        ],
        *[(F.col(f"ratio_{s}") - 1).alias(f"rel_diff_{s}") for s in ("min", "med", "max")],
    )


def trial_runtimes(
    runtimes: DataFrame, jobs_with_query: DataFrame, keys: list[str], warmup_trials: int
) -> DataFrame:
    """Runtime per trial: a job, or two adjacent jobs where a trial is two jobs.

    `runtimes` is (app_id, job_id, runtime_ms); `jobs_with_query` all started jobs with `keys`
    and `query`.
    """
    measured = attribution.jobs_without_warmup(jobs_with_query, warmup_trials).join(
        runtimes.select(*rollup.JOB, "runtime_ms"), rollup.JOB
    )
    two = attribution.is_two_job_query(F.col("query"))
    group = ["app_id", *keys]
    pairs = attribution.pair_trials(measured.where(two), group)
    singles = measured.where(~two).select(
        *group,
        F.col("trial_rank").alias("trial"),
        F.col("runtime_ms"),
        F.lit(True).alias("complete"),
    )
    return singles.unionByName(pairs)


def benchmark_lines(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Median, min and max seconds per (query, branch), with the query's place on the axis."""
    broken = trials.groupBy(*keys).agg(
        F.sum((~F.col("complete")).cast("long")).alias("incomplete_trials")
    )
    lines = stats.summary(trials, keys, "runtime_ms", (50,)).select(
        *keys,
        "n",
        ms_to_s(F.col("p50")).alias("median_s"),
        ms_to_s(F.col("min")).alias("min_s"),
        ms_to_s(F.col("max")).alias("max_s"),
    )
    # One row per query directory.
    axis = row_numbers(
        trials.select("query").distinct(), [], ["query"], "_rank"
    ).select("query", (F.col("_rank") - 1).alias("x"))
    return lines.join(axis, ["query"]).join(broken, keys)


def compare_branches(lines: DataFrame, left: str, right: str) -> DataFrame:
    """Two branches side by side per query."""

    def of(branch: str, column: str) -> Column:
        return F.max(F.when(F.col("branch") == branch, F.col(column)))

    return (
        lines.groupBy("query", "x")
        .agg(
            *[of(left, c).alias(f"left_{c}") for c in ("median_s", "min_s", "max_s")],
            *[of(right, c).alias(f"right_{c}") for c in ("median_s", "min_s", "max_s")],
        )
        .withColumn("ratio", F.try_divide("left_median_s", "right_median_s"))
    )


def estimate_report(
    models: DataFrame, jobs_with_query: DataFrame, keys: list[str], warmup_trials: int
) -> DataFrame:
    """Measured trials against the in-memory estimate, per key: one row per kind."""
    what_if = materialize(ideal.what_if_in_memory(models), "what_if")
    parts = []
    for kind, column in (("measured", "runtime_ms"), ("estimate", "estimate_ms")):
        runtimes = what_if.select(*rollup.JOB, F.col(column).cast("double").alias("runtime_ms"))
        trials = trial_runtimes(runtimes, jobs_with_query, keys, warmup_trials)
        parts.append(trials.withColumn("kind", F.lit(kind)))
    return benchmark_lines(parts[0].unionByName(parts[1]), [*keys, "kind"])


def num_tasks_report(runtimes: DataFrame, jobs: DataFrame, warmup_trials: int = 0) -> DataFrame:
    """Job seconds per (system, num_tasks): median with distances to the extremes.

    `jobs` is (app_id, job_id, system, num_tasks) of all started jobs.
    """
    kept = attribution.jobs_after_warmup_trials(jobs, warmup_trials)
    seconds = kept.join(runtimes.select(*rollup.JOB, "runtime_ms"), rollup.JOB).withColumn(
        "runtime_s", ms_to_s(F.col("runtime_ms"))
    )
    return stats.error_bars(stats.summary(seconds, ["system", "num_tasks"], "runtime_s", (50,)))


def compare_systems(report: DataFrame, left: str, right: str) -> DataFrame:
    """Medians of two systems side by side per number of tasks."""
    return report.groupBy("num_tasks").agg(
        F.max(F.when(F.col("system") == left, F.col("p50"))).alias("left_median_s"),
        F.max(F.when(F.col("system") == right, F.col("p50"))).alias("right_median_s"),
        F.max("max").alias("max_s"),
    )


def threads_report(runtimes: DataFrame, jobs: DataFrame, warmup: int = 0) -> DataFrame:
    """Box figures of job seconds per (phase, threads per disk).

    `jobs` is (app_id, job_id, threads) of all started jobs.
    """
    phased = attribution.jobs_by_phase(jobs, warmup).join(
        runtimes.select(*rollup.JOB, "runtime_ms"), rollup.JOB
    )
    seconds = phased.withColumn("runtime_s", ms_to_s(F.col("runtime_ms")))
    return stats.summary(seconds, ["phase", "threads"], "runtime_s", (25, 50, 75))
