"""From a directory of experiment runs to its report: one scan of all logs, keyed by what the
directories' names say."""

import functools
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.constants import NETWORK_GBPS_SORT
from sparkgauge.operators import attribution, ideal, rollup, utilization
from sparkgauge.operators.tasks import tasks_from_events
from sparkgauge.plans import reports
from sparkgauge.session import materialize
from sparkgauge.sources import event_log, experiments


class Runs(NamedTuple):
    """The runs of an experiment; `params` has app_id and what the directories say."""

    tasks: DataFrame
    job_stages: DataFrame
    params: DataFrame


def load(spark: SparkSession, root: str, kind: str, **task_options) -> Runs:
    """All runs below `root`, as directories with a file `event_log`, from one scan."""
    lines = event_log.read_lines(spark, root, recursiveFileLookup=True, pathGlobFilter="event_log")
    table = event_log.event_table(lines)
    events = table.select("app_id", "pos", "event")
    found = experiments.run_params(experiments.run_directories(spark, root), kind)
    return Runs(
        materialize(tasks_from_events(events.where("kind = 'task'"), **task_options), "run_tasks"),
        materialize(event_log.job_stages_from_events(events.where("kind = 'job'")), "run_job_stages"),
        materialize(found, "run_params"),
    )


def _runtimes(runs: Runs) -> DataFrame:
    attached = attribution.attach_jobs(runs.tasks, runs.job_stages)
    return rollup.job_runtimes(rollup.stage_summary(attached))


def _jobs(runs: Runs) -> DataFrame:
    return attribution.distinct_jobs(runs.job_stages).join(runs.params, "app_id")


def sort_runs(runs: Runs) -> DataFrame:
    """Map, reduce and total rows of every run, with the run's tasks and values per shuffle block."""
    models = materialize(
        reports.stage_models(runs.tasks, runs.job_stages, gbps=NETWORK_GBPS_SORT), "sort_models"
    )
    report = reports.sort_report(models, runs.job_stages)
    return runs.params.withColumnRenamed("order", "run_order").join(report, "app_id")


def sweep_runs(runs: Runs) -> DataFrame:
    """Task-count sweep: a row per run, with its number in the sweep."""
    models = materialize(reports.stage_models(runs.tasks, runs.job_stages), "sweep_models")
    return runs.params.join(reports.task_sweep_report(models, runs.job_stages), "app_id")


def system_runs(runs: Runs, warmup_trials: int = 0) -> DataFrame:
    """Job seconds per (system, num_tasks)."""
    return reports.num_tasks_report(_runtimes(runs), _jobs(runs), warmup_trials)


def disk_runs(runs: Runs, warmup: int = 0) -> DataFrame:
    """Box figures of job seconds per (phase, threads per disk)."""
    return reports.threads_report(_runtimes(runs), _jobs(runs), warmup)


def benchmark_runs(runs: Runs, branches: list[str], warmup_trials: int = 0) -> DataFrame:
    """Median, least and most seconds per (query, branch). Every query needs a log of each branch;
    logs of other branches are left out (`experiments.unknown_branches`)."""
    tree = runs.params.withColumnRenamed("app_id", "path")
    known = experiments.require_complete(tree, branches)
    jobs = _jobs(runs._replace(params=known.withColumnRenamed("path", "app_id")))
    trials = reports.trial_runtimes(_runtimes(runs), jobs, ["query", "branch"], warmup_trials)
    return reports.benchmark_lines(materialize(trials, "trials"), ["query", "branch"])


#: Figures of an executor's window that the resource reports hold.
RESOURCES = ["elapsed_ms", "n_tasks", "cpu_ms", "hdfs_deser_ms", "hdfs_ser_ms", "tx_bytes", "tx_idle_ms", "gc_ms"]
IDEALS = ["ideal_cpu_s", "ideal_network_s", "ideal_disk_s", "ser_deser_s", "ideal_s"]
KEYS = ["app_id", "report", "job_id", "stage_id", "executor_id", "measure"]


def long_figures(df: DataFrame, report: str, keys: list[str], figures: list[str]) -> DataFrame:
    """(KEYS, figure, value): a row for each figure that has a value."""
    pairs = [F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias("value")) for f in figures]
    kinds = {"job_id": "long", "stage_id": "long", "executor_id": "string", "measure": "string"}
    columns = [F.col(k) if k in keys else F.lit(None).cast(kind).alias(k) for k, kind in kinds.items()]
    rows = df.select("app_id", F.lit(report).alias("report"), *columns, F.explode(F.array(*pairs)).alias("p"))
    return rows.select(*KEYS, "p.*").where("value is not null")


def log_reports(
    tasks: DataFrame, job_stages: DataFrame, jobs_with_query: DataFrame, warmup_trials: int, rule: str = "reference"
) -> DataFrame:
    """Resource, utilization and ideal rows of every log, over the jobs after the warm-up, as one
    long table (app_id, report, job_id, stage_id, executor_id, measure, figure, value).

    The jobs are chosen first. The tasks of theirs are attached and written once; all reports of
    all logs are aggregates of that table and of the executor windows made from it.
    """
    kept = attribution.jobs_without_warmup(jobs_with_query, warmup_trials)
    job_tasks = materialize(
        attribution.attach_jobs(tasks, attribution.keep_jobs(job_stages, kept)), "measured_tasks"
    )
    metrics = materialize(rollup.executor_stage_metrics(job_tasks), "measured_metrics")
    models = materialize(ideal.ideal_stage(metrics), "measured_models")
    shares = utilization.utilizations(job_tasks, rule)
    figures = [c for c in shares.columns if c not in ("app_id", "measure")]
    stage, job = ["job_id", "stage_id"], ["job_id"]
    parts = [
        long_figures(metrics, "stage_resources", [*stage, "executor_id"], RESOURCES),
        long_figures(rollup.executor_job_metrics(metrics), "job_resources", [*job, "executor_id"], RESOURCES),
        long_figures(shares, "utilizations", ["measure"], figures),
        long_figures(models, "ideal_stage", stage, IDEALS),
        long_figures(ideal.ideal_job(models), "ideal_job", job, ["ideal_s", "actual_s", "total_stage_s"]),
    ]
    return _together(parts)


def _together(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


SUMMARY = ["n", "p5", "p25", "p50", "p75", "p95", "min", "max"]
DISK_FIGURES = ["bytes_read", "bytes_written", "millis_total", "utilization", "effective_Bps"]


def default_figures(outputs: dict[str, DataFrame]) -> DataFrame:
    """The outputs of `reports.default_report` as one long table (KEYS, figure, value)."""
    stage, executor = ["job_id", "stage_id"], ["executor_id"]
    shares = outputs["utilizations"]
    what = {
        "task_runtimes": ([], SUMMARY),
        "runtimes": ([], SUMMARY),
        "load_balance": ([], SUMMARY),
        "utilizations": (["measure"], [c for c in shares.columns if c not in ("app_id", "measure")]),
        "stage_resource_metrics": ([*stage, *executor], RESOURCES),
        "job_resource_metrics": (["job_id", *executor], RESOURCES),
        "stage_disks": ([*stage, *executor, "measure"], DISK_FIGURES),
        "job_disks": (["job_id", *executor, "measure"], DISK_FIGURES),
        "ideal_stage": (stage, IDEALS),
        "ideal_job": (["job_id"], ["ideal_s", "actual_s", "total_stage_s"]),
        "counter_checks": ([*stage, "measure"], ["base", "other", "rel_diff"]),
    }
    parts = []
    for name, (keys, figures) in what.items():
        named = {"disk": "measure", "check": "measure"}
        parts.append(long_figures(outputs[name].withColumnsRenamed(named), name, keys, figures))
    return _together(parts)
