"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge import schemas
from sparkgauge.functions.units import BIT_UNITS, scaled
from sparkgauge.operators import attribution, ideal, monitor, rollup, stats, utilization
from sparkgauge.operators import waterfall as lanes
from sparkgauge.operators.tasks import task_summary_text, tasks_from_events, with_input_size
from sparkgauge.plans import experiments as runs_of
from sparkgauge.plans import fixtures, reports
from sparkgauge.session import materialize, run_dir
from sparkgauge.sinks import text
from sparkgauge.sources import event_log, experiments, monitor_log

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Seconds and ratios that end in a 5 at the seventh place round differently by engine.
DIGITS = 6
FINE_DIGITS = 9


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for comparison with another engine."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _job_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attach_jobs(fixtures.tasks(spark, sf_dir), fixtures.job_stages(spark, sf_dir))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.stage_summary(_job_tasks(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str, disks: bool = True) -> DataFrame:
    return rollup.executor_stage_metrics(_job_tasks(spark, sf_dir), disks)


def _models(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return reports.stage_models(
        fixtures.tasks(spark, sf_dir), fixtures.job_stages(spark, sf_dir), **options
    )


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.distinct_jobs(fixtures.job_stages(spark, sf_dir))


def _runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.job_runtimes(_stages(spark, sf_dir))


def _experiment_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started jobs with the query and branch that the directory of their log names."""
    jobs = _jobs(spark, sf_dir)
    folders = fixtures.with_app_no(jobs).withColumn("folder", F.expr(fixtures.FOLDERS["benchmark"])).drop("app_no")
    params = experiments.run_params(folders.select(F.col("folder").alias("app_id")), "benchmark")
    return folders.join(params.withColumnRenamed("app_id", "folder"), "folder").select(
        "app_id", "job_id", "query", "branch"
    )


def _runs(spark: SparkSession, sf_dir: str, kind: str) -> runs_of.Runs:
    """Tasks and jobs of runs that are told apart by the directories of their logs."""
    tasks = fixtures.in_folders(fixtures.tasks(spark, sf_dir), kind)
    stages = fixtures.in_folders(fixtures.job_stages(spark, sf_dir), kind)
    return runs_of.Runs(tasks, stages, experiments.run_params(stages, kind))


# --- log decoding and task columns ---------------------------------------------------------

_NOT_FLAT = ("pos", "disks")


@query
def s3_p1_p17_decoded_tasks(spark, sf_dir):
    """Events as JSON text, decoded and flattened to task columns."""
    lines = fixtures.event_lines(spark, sf_dir)
    tasks = with_input_size(tasks_from_events(event_log.task_end_events(lines)))
    return rounded(tasks.drop(*_NOT_FLAT))


@query
def p6_task_disks(spark, sf_dir):
    """Per-disk counters of each task, from JSON text with one map per device."""
    tasks = tasks_from_events(event_log.task_end_events(fixtures.event_lines(spark, sf_dir)))
    rows = tasks.select("app_id", "task_id", "launch_ms", F.explode("disks").alias("disk", "d"))
    return rounded(
        rows.select(
            "app_id", "task_id", "launch_ms", "disk",
            F.col("d.`Disk Utilization`").alias("utilization"),
            F.col("d.`Read Throughput`").alias("read_Bps"),
            F.col("d.`Write Throughput`").alias("write_Bps"),
            F.col("d.`Start Counters`.`Sectors Read`").alias("start_sectors_read"),
            F.col("d.`End Counters`.`Sectors Written`").alias("end_sectors_written"),
            F.col("d.`End Counters`.`Millis Total`").alias("end_millis_total"),
        )
    )


@query
def s4_bad_line_counts(spark, sf_dir):
    """Broken lines per application: every 11th event line is cut, every 13th is no JSON."""
    lines = fixtures.event_lines(spark, sf_dir)
    key = F.col("pos.l_partkey") + F.col("pos.l_suppkey")
    value = F.col("value")
    broken = (
        F.when(key % 11 == 0, F.substring(value, F.lit(1), F.length(value) - 9))
        .when(key % 13 == 0, F.concat(F.lit("WARN "), value))
        .otherwise(value)
    )
    return event_log.bad_line_counts(lines.withColumn("value", broken))


@query
def s1_s5_one_pass(spark, sf_dir):
    """Tasks and broken lines per application out of one pass over a mixed log."""
    lines = fixtures.event_lines(spark, sf_dir)
    key = F.col("pos.l_partkey") + F.col("pos.l_suppkey")
    value = F.col("value")
    mixed = (
        F.when(key % 11 == 0, F.substring(value, F.lit(1), F.length(value) - 9))
        .when(key % 13 == 0, F.regexp_replace(value, "SparkListenerTaskEnd", "SparkListenerTaskStart"))
        .otherwise(value)
    )
    table = event_log.event_table(lines.withColumn("value", mixed))
    return table.groupBy("app_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event.Task Info.Task ID").alias("sum_task_id")
    )


@query
def s4_s5_odd_lines(spark, sf_dir):
    """Fields of another type, bare NaN, repeated keys, text after the object: per application, what
    each reader of a log makes of the same lines."""
    lines = fixtures.event_lines(spark, sf_dir)
    key = F.col("pos.l_partkey") + F.col("pos.l_suppkey")
    value = F.col("value")

    def put(text, field, to):
        return F.regexp_replace(text, f'"{field}":[-0-9.E]+', f'"{field}":{to}')

    half = put(value, "JVM GC Time", "7.5")
    twice = F.regexp_replace(value, '"Stage ID":', '"Stage ID":-1,"Stage ID":')
    other = F.regexp_replace(put(twice, "JVM GC Time", "NaN"), "SparkListenerTaskEnd", "SparkListenerTaskStart")
    odd = (
        F.when(key % 29 == 0, F.substring(value, F.lit(1), F.length(value) - 9))
        .when(key % 17 == 0, put(value, "JVM GC Time", "NaN"))
        .when(key % 19 == 0, put(half, "Bytes Received Per Second", "NaN"))
        .when(key % 23 == 0, F.regexp_replace(half, '"Stage ID":', '"Stage ID":-1,"Stage ID":'))
        .when(key % 7 == 0, other)
        .when(key % 11 == 0, put(twice, "Bytes Received Per Second", "-Infinity"))
        .when(key % 13 == 0, F.concat(value, F.lit("{}")))
        .otherwise(value)
    )
    lines = materialize(lines.withColumn("value", odd), "odd_lines")
    table = event_log.event_table(lines)
    counted = [
        event_log.task_end_events(lines).select(
            "app_id", F.lit("tasks").alias("reader"), F.col("event.Task Metrics.JVM GC Time").alias("gc")
        ),
        event_log.odd_tasks(lines).select("app_id", F.lit("odd_tasks"), F.lit(None).cast("long")),
        event_log.bad_lines(lines).select("app_id", F.lit("bad_lines"), F.lit(None).cast("long")),
        table.select("app_id", F.concat(F.lit("table_"), "kind"), F.col("event.Task Metrics.JVM GC Time")),
    ]
    rows = counted[0]
    for part in counted[1:]:
        rows = rows.union(part)
    return rows.groupBy("app_id", "reader").agg(F.count(F.lit(1)).alias("n"), F.sum("gc").alias("sum_gc"))


@query
def s1_s2_event_files(spark, sf_dir):
    """Rolled, compressed logs read from files: lines, tasks, and the first and last task in log order."""
    lines = event_log.read_lines(spark, f"{fixtures.event_files(spark, sf_dir)}/eventlog_v2_*/events_*")
    tasks = tasks_from_events(event_log.task_end_events(lines))
    return tasks.groupBy(F.regexp_extract("app_id", "eventlog_v2_([^/]*)$", 1).alias("app_id")).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.countDistinct("pos").alias("n_places"),
        F.min_by("task_id", "pos").alias("first_task"),
        F.max_by("task_id", "pos").alias("last_task"),
        F.sum("runtime_ms").alias("runtime_ms"),
    )


@query
def f1_two_phase_tasks(spark, sf_dir):
    """A job filter first; only task lines of its stages are decoded whole."""
    kept = attribution.filter_jobs(
        fixtures.job_stages(spark, sf_dir), lambda jobs: jobs.where(F.col("job_id") % 4 == 1)
    )
    kept = materialize(kept, "kept_stages")
    events = event_log.task_end_events_of(fixtures.event_lines(spark, sf_dir), kept)
    return (
        attribution.attach_jobs(tasks_from_events(events), kept)
        .groupBy("app_id", "job_id")
        .agg(F.count(F.lit(1)).alias("n_tasks"), F.sum("runtime_ms").alias("runtime_ms"))
    )


@query
def s5_mixed_log_events(spark, sf_dir):
    """Event dispatch: task ends out of a log that also holds job starts and other events."""
    lines = fixtures.event_lines(spark, sf_dir)
    other = F.col("pos.l_linenumber") == 7
    renamed = F.regexp_replace("value", "SparkListenerTaskEnd", "SparkListenerTaskStart")
    mixed = lines.withColumn("value", F.when(other, renamed).otherwise(F.col("value")))
    events = event_log.task_end_events(mixed, schemas.TASK_IDS)
    return events.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.sum(F.col("event.`Task Info`.`Task ID`")).alias("sum_task_id"),
    )


@query
def j3_job_names(spark, sf_dir):
    """Job starts as JSON text: jobs named after their highest stage."""
    per_job = (
        fixtures.job_stages(spark, sf_dir)
        .groupBy("app_id", "job_id")
        .agg(F.sort_array(F.collect_list("stage_id")).alias("ids"))
    )
    infos = F.transform(
        "ids",
        lambda s: F.struct(
            s.alias("Stage ID"), F.concat(F.lit("stage at "), s.cast("string")).alias("Stage Name")
        ),
    )
    event = F.struct(
        F.lit("SparkListenerJobStart").alias("Event"),
        F.col("job_id").alias("Job ID"),
        (F.col("job_id") * fixtures.JOB_PERIOD_MS).alias("Submission Time"),
        F.col("ids").alias("Stage IDs"),
        infos.alias("Stage Infos"),
    )
    lines = per_job.select("app_id", F.col("job_id").alias("pos"), F.to_json(event).alias("value"))
    starts = event_log.job_start_events(lines)
    stages = event_log.job_stages_from_events(starts).groupBy("app_id", "job_id").agg(
        F.count(F.lit(1)).alias("n_stages"), F.max("stage_id").alias("top_stage")
    )
    return event_log.jobs_from_events(starts).drop("pos").join(stages, ["app_id", "job_id"])


@query
def p18_task_text(spark, sf_dir):
    """Readable task lines (text layout, not compared)."""
    return task_summary_text(fixtures.tasks(spark, sf_dir))


@query
def s7_experiment_params(spark, sf_dir):
    """Run parameters parsed from directory names, one per order."""
    orders = fixtures.table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text_of = lambda column: column.cast("string")
    named = orders.select(
        "o_orderkey",
        F.concat_ws("_", F.lit("a"), F.lit("b"), text_of(cust % 64), F.lit("d"), text_of(key % 9), text_of(key % 50)).alias("sort_dir"),
        F.concat_ws("_", F.lit("experiment_log"), text_of(key % 20), text_of(cust % 1000), F.lit("x")).alias("sweep_dir"),
        F.concat_ws("_", F.lit("experiment_log"), F.lit("disk"), text_of(cust % 8), text_of(key)).alias("disk_dir"),
    )
    sort = experiments.sort_params(F.col("sort_dir"))
    return named.select(
        "o_orderkey",
        *[column.alias(f"sort_{name}") for name, column in sort.items()],
        experiments.sweep_number(F.col("sweep_dir")).alias("sweep_number"),
        experiments.sweep_num_tasks(F.col("sweep_dir")).alias("sweep_num_tasks"),
        experiments.threads_per_disk(F.col("disk_dir")).alias("threads"),
    )


def _tree(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders")
    branch = F.element_at(F.array(*[F.lit(b) for b in ("left", "right", "extra")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("file:/logs/q"), (F.col("o_custkey") % 997).cast("string"), F.lit("/"), branch, F.lit("/event_log"))
    return experiments.experiment_tree(orders.select(path.alias("path")).distinct())


@query
def s6_missing_branches(spark, sf_dir):
    """(query, branch) pairs without an event log in a tree of paths."""
    return experiments.missing_branches(_tree(spark, sf_dir), ["left", "right"])


@query
def s6_unknown_branches(spark, sf_dir):
    """Logs of branches nobody asked for."""
    return experiments.unknown_branches(_tree(spark, sf_dir), ["left", "right"])


# --- attribution and filters ---------------------------------------------------------------

@query
def j1_job_tasks(spark, sf_dir):
    """Task-to-job attribution with the log-order gate."""
    return _job_tasks(spark, sf_dir).select(
        "app_id", "job_id", "stage_id", "executor_id", "task_id", "launch_ms", "runtime_ms"
    )


@query
def j2_orphan_tasks(spark, sf_dir):
    return attribution.orphan_tasks(
        fixtures.tasks(spark, sf_dir), fixtures.job_stages(spark, sf_dir)
    ).select("app_id", "stage_id", "task_id", "launch_ms", "finish_ms")


@query
def f1_filtered_jobs(spark, sf_dir):
    """A caller's filter (odd jobs) applied before attribution."""
    kept = attribution.filter_jobs(
        fixtures.job_stages(spark, sf_dir), lambda jobs: jobs.where(F.col("job_id") % 2 == 1)
    )
    return (
        attribution.attach_jobs(fixtures.tasks(spark, sf_dir), kept)
        .groupBy("app_id", "job_id")
        .agg(F.count(F.lit(1)).alias("n_tasks"))
    )


@query
def f2_small_jobs(spark, sf_dir):
    return attribution.small_jobs(_stages(spark, sf_dir))


@query
def f3_t5_jobs_from_second_shuffle(spark, sf_dir):
    stages = materialize(_stages(spark, sf_dir), "stages")
    return attribution.jobs_from_second_shuffle(_jobs(spark, sf_dir), stages)


@query
def f4_jobs_after_setup(spark, sf_dir):
    return attribution.jobs_after_setup(_jobs(spark, sf_dir))


@query
def f5_jobs_after_warmup_trials(spark, sf_dir):
    return attribution.jobs_after_warmup_trials(_jobs(spark, sf_dir), 2)


@query
def f6_jobs_without_warmup(spark, sf_dir):
    return attribution.jobs_without_warmup(_experiment_jobs(spark, sf_dir), 2)


@query
def f7_jobs_by_phase(spark, sf_dir):
    return attribution.jobs_by_phase(_jobs(spark, sf_dir), 1)


@query
def f8_shuffle_jobs(spark, sf_dir):
    return attribution.shuffle_jobs(_stages(spark, sf_dir))


# --- rollups -------------------------------------------------------------------------------

@query
def a10_a11_a9_stage_summary(spark, sf_dir):
    return rounded(_stages(spark, sf_dir))


@query
def a22_stage_input_labels(spark, sf_dir):
    return rollup.stage_input_labels(_job_tasks(spark, sf_dir))


@query
def t3_longest_tasks(spark, sf_dir):
    return rollup.longest_tasks(_job_tasks(spark, sf_dir))


@query
def t2_last_significant_stage(spark, sf_dir):
    return rollup.last_significant_stage(_stages(spark, sf_dir), 60000)


@query
def a16_a17_job_runtimes(spark, sf_dir):
    return _runtimes(spark, sf_dir)


@query
def a15_load_balance(spark, sf_dir):
    return rounded(rollup.load_balance(_job_tasks(spark, sf_dir)))


@query
def a15_a1_load_balance_summary(spark, sf_dir):
    return rounded(stats.summary(rollup.load_balance(_job_tasks(spark, sf_dir)), ["app_id"], "badness"))


@query
def a1_task_runtime_summary(spark, sf_dir):
    return rounded(stats.summary(_job_tasks(spark, sf_dir), ["app_id"], "runtime_ms"))


@query
def a1_job_runtime_summary(spark, sf_dir):
    return rounded(stats.summary(_runtimes(spark, sf_dir), ["app_id"], "runtime_ms"))


@query
def a4_a8_executor_stage_metrics(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir, disks=False))


@query
def a7_j4_executor_stage_disks(spark, sf_dir):
    return rounded(rollup.executor_stage_disks(_metrics(spark, sf_dir)))


@query
def a14_executor_job_metrics(spark, sf_dir):
    return rounded(rollup.executor_job_metrics(_metrics(spark, sf_dir, disks=False)))


@query
def a14_executor_job_disks(spark, sf_dir):
    return rounded(rollup.executor_job_disks(rollup.executor_stage_disks(_metrics(spark, sf_dir))))


@query
def j5_executor_hosts(spark, sf_dir):
    return rollup.executor_hosts(_job_tasks(spark, sf_dir))


# --- distributions -------------------------------------------------------------------------

@query
def a2_a3_utilization_reference(spark, sf_dir):
    """Weighted percentiles of every measure, one percentile per row at most."""
    return rounded(utilization.utilizations(_job_tasks(spark, sf_dir), "reference"))


@query
def a2_a3_utilization_standard(spark, sf_dir):
    return rounded(utilization.utilizations(_job_tasks(spark, sf_dir), "standard"))


@query
def a2_stage_weighted_runtime(spark, sf_dir):
    """Weighted percentiles over small groups, where a row may skip percentiles."""
    pairs = _job_tasks(spark, sf_dir).select(
        "app_id", "stage_id", "executor_id",
        (F.col("runtime_ms") % 700).cast("double").alias("value"), F.col("runtime_ms").alias("weight"),
    )
    return rounded(
        stats.weighted_percentiles(pairs, ["app_id", "stage_id", "executor_id"], rule="reference")
    )


@query
def p22_idle_fractions(spark, sf_dir):
    return rounded(
        utilization.idle_fractions(utilization.utilizations(_job_tasks(spark, sf_dir), "standard"))
    )


@query
def w3_compute_cdf(spark, sf_dir):
    return stats.cdf(_job_tasks(spark, sf_dir), rollup.STAGE, "compute_ms")


# --- models --------------------------------------------------------------------------------

_IDEAL = [*rollup.STAGE, "n_executors", "n_tasks", "runtime_ms"]


@query
def m1_m4_ideal_stage(spark, sf_dir):
    return rounded(
        _models(spark, sf_dir).select(
            *_IDEAL, "network_mb", "n_disks", "ideal_cpu_s", "ideal_network_s", "ideal_disk_s",
            "ideal_s", "bottleneck", "has_shuffle_read",
        ),
        FINE_DIGITS,
    )


@query
def m3b_m5b_ideal_from_disk_times(spark, sf_dir):
    models = ideal.ideal_stage(_metrics(spark, sf_dir), disk_from_task_times=True)
    return rounded(models.select(*rollup.STAGE, "ideal_disk_s", "fixed_disk_s", "ideal_s", "fixed_s"), FINE_DIGITS)


@query
def m5_ideal_stage_fixed(spark, sf_dir):
    return rounded(
        _models(spark, sf_dir).select(
            *rollup.STAGE, "fixed_cpu_s", "fixed_network_s", "fixed_disk_s", "fixed_s"
        ),
        FINE_DIGITS,
    )


@query
def m6_m7_ser_and_disk_read(spark, sf_dir):
    return rounded(_models(spark, sf_dir).select(*rollup.STAGE, "ser_deser_s", "disk_read_s"), FINE_DIGITS)


@query
def m8_m9_ideal_job(spark, sf_dir):
    return rounded(ideal.ideal_job(_models(spark, sf_dir)), FINE_DIGITS)


@query
def m10_what_if_in_memory(spark, sf_dir):
    return rounded(ideal.what_if_in_memory(_models(spark, sf_dir)), FINE_DIGITS)


@query
def m11_counter_checks(spark, sf_dir):
    return rounded(ideal.counter_checks(_models(spark, sf_dir)))


# --- composite reports ---------------------------------------------------------------------

@query
def g2_small_job_tasks(spark, sf_dir):
    """Shuffle report: task runtimes of the small jobs only."""
    kept = attribution.small_jobs(_stages(spark, sf_dir))
    selected = attribution.keep_jobs(fixtures.job_stages(spark, sf_dir), kept)
    tasks = attribution.attach_jobs(fixtures.tasks(spark, sf_dir), selected)
    return rounded(stats.summary(tasks, ["app_id", "job_id"], "runtime_ms"))


@query
def g3_sort_phases(spark, sf_dir):
    models = materialize(_models(spark, sf_dir, gbps=reports.NETWORK_GBPS_SORT), "sort_models")
    return rounded(reports.sort_report(models, fixtures.job_stages(spark, sf_dir)), FINE_DIGITS)


@query
def g4_k8_task_sweep(spark, sf_dir):
    models = materialize(_models(spark, sf_dir), "sweep_models")
    return rounded(reports.task_sweep_report(models, fixtures.job_stages(spark, sf_dir)), FINE_DIGITS)


@query
def p23_sweep_plot_columns(spark, sf_dir):
    models = materialize(_models(spark, sf_dir), "sweep_models")
    report = reports.task_sweep_report(models, fixtures.job_stages(spark, sf_dir))
    return rounded(reports.sweep_plot_columns(report), FINE_DIGITS)


def _trials(spark, sf_dir):
    runtimes = materialize(_runtimes(spark, sf_dir), "runtimes")
    return reports.trial_runtimes(
        runtimes, _experiment_jobs(spark, sf_dir), ["query", "branch"], 1
    )


@query
def w4_paired_trials(spark, sf_dir):
    return _trials(spark, sf_dir)


@query
def g5_k9_t4_benchmark_lines(spark, sf_dir):
    trials = materialize(_trials(spark, sf_dir), "trials")
    return rounded(reports.benchmark_lines(trials, ["query", "branch"]))


@query
def j7_benchmark_compare(spark, sf_dir):
    trials = materialize(_trials(spark, sf_dir), "trials")
    lines = materialize(reports.benchmark_lines(trials, ["query", "branch"]), "lines")
    return rounded(reports.compare_branches(lines, "left", "right"))


@query
def g6_estimate_report(spark, sf_dir):
    models = materialize(_models(spark, sf_dir), "models")
    return rounded(
        reports.estimate_report(models, _experiment_jobs(spark, sf_dir), ["query", "branch"], 1),
        FINE_DIGITS,
    )


@query
def g7_a19_a21_num_tasks(spark, sf_dir):
    return rounded(runs_of.system_runs(_runs(spark, sf_dir, "systems"), 1))


@query
def g7_compare_systems(spark, sf_dir):
    report = materialize(runs_of.system_runs(_runs(spark, sf_dir, "systems"), 1), "num_tasks")
    return rounded(reports.compare_systems(report, "left", "right"))


@query
def g8_a20_threads_box(spark, sf_dir):
    return rounded(runs_of.disk_runs(_runs(spark, sf_dir, "disk"), 1))


@query
def k7_g3_sort_runs(spark, sf_dir):
    """Sort report keyed by what the runs' directories say."""
    return rounded(runs_of.sort_runs(_runs(spark, sf_dir, "sort")).drop("app_id"), FINE_DIGITS)


@query
def g4_sweep_runs(spark, sf_dir):
    return rounded(runs_of.sweep_runs(_runs(spark, sf_dir, "sweep")).drop("app_id"), FINE_DIGITS)


@query
def g5_log_reports(spark, sf_dir):
    """Resource, utilization and ideal rows of every log of a benchmark, after its warm-up."""
    jobs = _experiment_jobs(spark, sf_dir)
    return rounded(
        runs_of.log_reports(fixtures.tasks(spark, sf_dir), fixtures.job_stages(spark, sf_dir), jobs, 1)
    )


@query
def g1_default_report(spark, sf_dir):
    """The default report, written under a run id and read back, as one long table."""
    outputs = reports.default_report(fixtures.tasks(spark, sf_dir), fixtures.job_stages(spark, sf_dir))
    folder, run_id = f"{run_dir(spark)}/reports", uuid.uuid4().hex
    text.write_report(outputs, folder, run_id)
    return rounded(runs_of.default_figures(text.read_report(spark, folder, run_id)))


# --- monitor -------------------------------------------------------------------------------

def _relative(spark, sf_dir):
    return monitor.with_relative_time(fixtures.monitor_ticks(spark, sf_dir))


def _ticks(spark, sf_dir):
    return monitor.monitor_samples(monitor.finite_samples(_relative(spark, sf_dir)))


def _tick_id(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", F.col("pos.event_id")).drop("pos")


@query
def g9_p20_monitor_samples(spark, sf_dir):
    return rounded(_tick_id(_ticks(spark, sf_dir)), FINE_DIGITS)


@query
def j6_monitor_disks(spark, sf_dir):
    return rounded(_tick_id(monitor.monitor_disks(monitor.finite_samples(_relative(spark, sf_dir)))))


@query
def s8_s9_decoded_monitor(spark, sf_dir):
    """Monitor text with a non-JSON prefix and a cut tail per host: whole samples only."""
    ticks = fixtures.monitor_ticks(spark, sf_dir)
    cut = F.col("event_id") % 1000 == 999
    early = F.col("time_ms") < 1704153600000
    line = F.to_json("sample")
    value = F.when(early, F.concat(F.lit("starting "), line)).when(
        cut, F.substring(line, F.lit(1), F.length(line) - 5)
    ).otherwise(line)
    lines = ticks.select("host", "pos", value.alias("value"))
    whole = monitor_log.whole_samples(monitor_log.decode_samples(lines))
    return whole.select(
        "host",
        F.col("pos.event_id").alias("event_id"),
        F.col("sample.`Current Time`").alias("time_ms"),
        F.col("sample.`Total Started Macrotasks`").alias("total_started"),
        F.isnan(F.col("sample.`Network Utilization`.`Bytes Received Per Second`")).alias("rx_nan"),
    )


@query
def s9_odd_ticks(spark, sf_dir):
    """Ticks with a rate that is no number, a fractional byte count and a repeated key end no file."""
    ticks = fixtures.monitor_ticks(spark, sf_dir)
    line = F.to_json("sample")
    half = F.regexp_replace(line, '"Outstanding Network Bytes":[0-9]+', '"Outstanding Network Bytes":5.5')
    odd = F.regexp_replace(half, '"Bytes Received Per Second":[^,}]+', '"Bytes Received Per Second":NaN')
    twice = F.regexp_replace(line, '"Current Time":', '"Current Time":0,"Current Time":')
    value = F.when(F.col("event_id") % 50 == 3, odd).when(F.col("event_id") % 50 == 4, twice).otherwise(line)
    whole = monitor_log.whole_samples(
        monitor_log.decode_samples(ticks.select("host", "pos", value.alias("value")))
    )
    return whole.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_ticks"),
        F.count("sample.`Outstanding Network Bytes`").alias("n_outstanding"),
        F.sum("sample.`Current Time`").alias("sum_time_ms"),
    )


@query
def s8_monitor_files(spark, sf_dir):
    """Monitor logs read from files: ticks per host, and the first and last in file order."""
    folder = fixtures.monitor_files(spark, sf_dir)
    lines = monitor_log.read_monitor_lines(spark, f"{folder}/logs")
    whole = monitor_log.whole_samples(monitor_log.decode_samples(lines))
    time = F.col("sample.`Current Time`")
    return whole.groupBy(F.regexp_extract("host", "([^/]*)_executor_monitor$", 1).alias("host")).agg(
        F.count(F.lit(1)).alias("n_ticks"),
        F.min_by(time, "pos").alias("first_ms"),
        F.max_by(time, "pos").alias("last_ms"),
    )


@query
def p21_monitor_panels(spark, sf_dir):
    samples = monitor.finite_samples(_relative(spark, sf_dir))
    panels = monitor.monitor_panels(monitor.monitor_samples(samples), monitor.monitor_disks(samples))
    return rounded(
        panels.groupBy("host", "panel", "metric", "disk").agg(
            F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("highest")
        )
    )


@query
def p24_disk_series(spark, sf_dir):
    samples = monitor.finite_samples(_relative(spark, sf_dir))
    panels = monitor.monitor_panels(monitor.monitor_samples(samples), monitor.monitor_disks(samples))
    chosen = monitor.series(panels.where("panel = 'one_disk'"), "running", "xvdb")
    return rounded(_tick_id(chosen.select("host", "pos", "time", "value")))


@query
def w5_started_deltas(spark, sf_dir):
    ticks = _ticks(spark, sf_dir)
    return _tick_id(monitor.started_deltas(ticks, cut_on="time"))


@query
def k10_started_spikes(spark, sf_dir):
    return _tick_id(monitor.spikes(monitor.started_deltas(_ticks(spark, sf_dir), cut_on="time")))


# --- waterfall -----------------------------------------------------------------------------

def _lanes(spark, sf_dir):
    return lanes.waterfall(lanes.parse_work_lines(fixtures.work_lines(spark, sf_dir)))


@query
def s10_f14_work_lines(spark, sf_dir):
    return lanes.parse_work_lines(fixtures.work_lines(spark, sf_dir))


@query
def w7_w8_waterfall(spark, sf_dir):
    return _lanes(spark, sf_dir)


@query
def g10_waterfall_extent(spark, sf_dir):
    return lanes.waterfall_extent(materialize(_lanes(spark, sf_dir), "lanes"))


# --- text ----------------------------------------------------------------------------------

@query
def x3_x4_scaled_units(spark, sf_dir):
    """Sizes of every order of magnitude, negative ones too, as value and unit."""
    price = F.col("o_totalprice")
    size = F.floor(F.pow(F.lit(10.0), F.col("o_orderkey") % 11) * price) * F.when(
        F.col("o_custkey") % 2 == 0, -1
    ).otherwise(1)
    orders = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"))
    return rounded(
        orders.select(
            "o_orderkey",
            scaled(F.col("size"))["value"].alias("bytes_value"),
            scaled(F.col("size"))["unit"].alias("bytes_unit"),
            scaled(F.col("size"), BIT_UNITS)["value"].alias("bits_value"),
            scaled(F.col("size"), BIT_UNITS)["unit"].alias("bits_unit"),
        )
    )


@query
def k3_x5_stage_report_text(spark, sf_dir):
    return text.stage_report_text(_metrics(spark, sf_dir))


@query
def k4_job_report_text(spark, sf_dir):
    metrics = materialize(_metrics(spark, sf_dir), "metrics")
    return text.job_report_text(
        rollup.executor_job_metrics(metrics),
        rollup.executor_job_disks(rollup.executor_stage_disks(metrics)),
    )


@query
def k5_ideal_report_text(spark, sf_dir):
    return text.ideal_stage_text(_models(spark, sf_dir))
