"""Ideal-time models: how long a stage or job would take if one resource were the only limit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.constants import (
    BYTES_PER_GIBIT,
    BYTES_PER_MB,
    CORES_PER_EXECUTOR,
    COUNTER_TOLERANCE,
    DISK_BYTES_PER_SECOND,
    MODEL_DISKS,
    NETWORK_GBPS,
)
from sparkgauge.operators.rollup import JOB, STAGE


def _disk_columns(disks: tuple[str, ...]) -> dict[str, Column]:
    """Per-executor disk figures as plain numbers, so the stage aggregate needs no join."""
    counted = F.filter("disks", lambda d: d["disk"].isin(*disks))

    def total(value) -> Column:
        return F.aggregate(
            counted, F.lit(0.0), lambda acc, d: acc + F.coalesce(value(d).cast("double"), F.lit(0.0))
        )

    def seconds(d: Column) -> Column:
        moved = d["bytes_read"] + d["bytes_written"]
        return F.when(
            (moved > 0) & (d["effective_Bps"] > 0), moved / F.nullif(d["effective_Bps"], F.lit(0.0))
        ).otherwise(0.0)

    names = F.transform(counted, lambda d: d["disk"])
    mask = F.lit(0)
    for bit, name in enumerate(disks):
        mask = mask + F.when(F.array_contains(names, name), F.lit(1 << bit)).otherwise(F.lit(0))
    return {
        "disk_bytes": total(lambda d: d["bytes_read"] + d["bytes_written"]),
        "disk_bytes_read": total(lambda d: d["bytes_read"]),
        "disk_Bps": total(lambda d: d["effective_Bps"]),
        "slowest_disk_s": F.coalesce(F.array_max(F.transform(counted, seconds)), F.lit(0.0)),
        "n_disks": F.size(counted),
        "disk_mask": mask,
    }


def ideal_stage(
    metrics: DataFrame,
    gbps: float = NETWORK_GBPS,
    cores: int = CORES_PER_EXECUTOR,
    disks: tuple[str, ...] = MODEL_DISKS,
    disk_from_task_times: bool = False,
) -> DataFrame:
    """All per-stage models from the executor metrics, in one aggregate.

    ideal_*: work spread freely over the stage's executors. fixed_*: every executor keeps its
    own work, so the slowest executor counts. CPU comes from the tasks' compute times and, where
    these are 0, from the executors' OS counters (for fixed_*, executor by executor).
    """
    per_executor = metrics.select(
        *STAGE,
        "start_ms",
        "end_ms",
        "n_tasks",
        "cpu_ms",
        "compute_ms",
        "disk_ms",
        "tx_bytes",
        "network_mb",
        "shuffle_read_mb",
        (F.col("hdfs_deser_ms") + F.col("hdfs_ser_ms")).alias("ser_deser_ms"),
        F.when(F.col("compute_ms") == 0, F.col("cpu_ms")).otherwise(F.col("compute_ms")).alias("own_cpu_ms"),
        *[column.alias(name) for name, column in _disk_columns(disks).items()],
    )
    fixed_disk = (
        F.max(F.try_divide(F.col("disk_ms"), F.col("n_disks") * 1000.0))
        if disk_from_task_times
        else F.max("slowest_disk_s")
    )
    stage = per_executor.groupBy(*STAGE).agg(
        F.count(F.lit(1)).alias("n_executors"),
        F.sum("n_tasks").alias("n_tasks"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("finish_ms"),
        F.sum("cpu_ms").alias("os_cpu_ms"),
        F.sum("compute_ms").alias("compute_ms"),
        F.sum("disk_ms").alias("disk_ms"),
        F.sum("tx_bytes").alias("tx_bytes"),
        F.sum("network_mb").alias("network_mb"),
        F.sum("shuffle_read_mb").alias("shuffle_read_mb"),
        F.sum("ser_deser_ms").alias("ser_deser_ms"),
        F.sum("disk_bytes").alias("disk_bytes"),
        F.sum("disk_bytes_read").alias("disk_bytes_read"),
        F.sum("disk_Bps").alias("disk_Bps"),
        F.bit_count(F.bit_or("disk_mask")).cast("long").alias("n_disks"),
        (F.max("own_cpu_ms") / (cores * 1000.0)).alias("fixed_cpu_s"),
        (F.max("tx_bytes") / (gbps * BYTES_PER_GIBIT)).alias("fixed_network_s"),
        fixed_disk.alias("fixed_disk_s"),
    )
    slots = F.col("n_executors") * (cores * 1000.0)
    devices = F.col("n_executors") * F.col("n_disks")
    cpu_ms = F.when(F.col("compute_ms") > 0, F.col("compute_ms")).otherwise(F.col("os_cpu_ms"))
    disk_s = (
        F.try_divide(F.col("disk_ms"), devices * 1000.0)
        if disk_from_task_times
        else F.when(
            F.col("disk_Bps") > 0,
            F.try_divide(F.col("disk_bytes"), devices * DISK_BYTES_PER_SECOND),
        ).otherwise(0.0)
    )
    modelled = (
        stage.withColumn("runtime_ms", F.col("finish_ms") - F.col("start_ms"))
        .withColumn("ideal_cpu_s", cpu_ms / slots)
        .withColumn(
            "ideal_network_s",
            F.col("tx_bytes") / (F.col("n_executors") * (gbps * BYTES_PER_GIBIT)),
        )
        .withColumn("ideal_disk_s", disk_s)
        .withColumn("ser_deser_s", F.col("ser_deser_ms") / slots)
        .withColumn(
            "disk_read_s",
            F.try_divide(F.col("disk_bytes_read"), devices * DISK_BYTES_PER_SECOND),
        )
        .withColumn("has_shuffle_read", F.col("shuffle_read_mb") > 0)
    )
    for kind in ("ideal", "fixed"):
        parts = [F.col(f"{kind}_{r}_s") for r in ("cpu", "network", "disk")]
        modelled = modelled.withColumn(f"{kind}_s", F.greatest(*parts))
    return modelled.withColumn("bottleneck", _bottleneck())


def _bottleneck() -> Column:
    top = F.col("ideal_s")
    return (
        F.when(F.col("ideal_cpu_s") == top, "cpu")
        .when(F.col("ideal_network_s") == top, "network")
        .when(F.col("ideal_disk_s") == top, "disk")
    )


def ideal_job(stages: DataFrame) -> DataFrame:
    """Job totals: ideal, fixed-executor and fluid times against the actual ones.

    The fluid ideal lets a resource move between stages: the largest of the per-resource sums.
    """
    return (
        stages.groupBy(*JOB)
        .agg(
            F.count(F.lit(1)).alias("n_stages"),
            F.sum("ideal_s").alias("ideal_s"),
            F.sum("fixed_s").alias("fixed_s"),
            F.sum("ideal_cpu_s").alias("cpu_s"),
            F.sum("ideal_network_s").alias("network_s"),
            F.sum("ideal_disk_s").alias("disk_s"),
            F.sum("ser_deser_s").alias("ser_deser_s"),
            ((F.max("finish_ms") - F.min("start_ms")) / 1000.0).alias("actual_s"),
            (F.sum("runtime_ms") / 1000.0).alias("total_stage_s"),
        )
        .withColumn("fluid_s", F.greatest("cpu_s", "network_s", "disk_s"))
        .withColumn("actual_over_ideal", F.try_divide("actual_s", "ideal_s"))
        .withColumn(
            "bottleneck",
            F.when(F.col("cpu_s") == F.col("fluid_s"), "cpu")
            .when(F.col("network_s") == F.col("fluid_s"), "network")
            .when(F.col("disk_s") == F.col("fluid_s"), "disk"),
        )
    )


def what_if_in_memory(stages: DataFrame) -> DataFrame:
    """Job runtime if the input were already deserialized in memory.

    A stage that spent time on (de)serialization shrinks by the ratio of its ideal times with
    and without that time and its disk reads; the job shrinks by what its stages lose.
    """
    without = F.greatest(
        F.col("ideal_cpu_s") - F.col("ser_deser_s"),
        F.col("ideal_network_s"),
        F.col("ideal_disk_s") - F.coalesce("disk_read_s", F.lit(0.0)),
    )
    kept = F.when(
        F.col("ser_deser_s") > 0,
        F.coalesce(F.try_divide(without, F.col("ideal_s")), F.lit(1.0)),
    ).otherwise(1.0)
    lost = F.col("runtime_ms") * (1.0 - kept)
    return (
        stages.groupBy(*JOB)
        .agg(
            (F.max("finish_ms") - F.min("start_ms")).alias("runtime_ms"),
            F.sum(lost).alias("saved_ms"),
        )
        .withColumn("estimate_ms", F.col("runtime_ms") - F.col("saved_ms"))
    )


def counter_checks(stages: DataFrame, tolerance: float = COUNTER_TOLERANCE) -> DataFrame:
    """Executor counters against task metrics: CPU millis and network MB per stage."""

    def check(name: str, base: Column, other: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            base.cast("double").alias("base"),
            other.cast("double").alias("other"),
        )

    transmitted_mb = F.floor(F.col("tx_bytes") / F.lit(float(BYTES_PER_MB)))
    both = F.array(
        check("cpu_ms", F.col("compute_ms"), F.col("os_cpu_ms")),
        check("network_mb", F.col("network_mb"), transmitted_mb),
    )
    rel_diff = F.try_divide(F.abs(F.col("other") - F.col("base")), F.col("base"))
    return (
        stages.select(*STAGE, F.explode(both).alias("c"))
        .select(*STAGE, "c.*")
        .where(F.col("base") > 0)
        .withColumn("rel_diff", rel_diff)
        .withColumn("flagged", (F.col("rel_diff") > tolerance) & (F.col("other") > 0))
    )
