"""Utilization while tasks ran, weighted by how long they ran."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.constants import CORES_PER_EXECUTOR, LINK_BYTES_PER_SECOND, UTILIZATION_DISKS
from sparkgauge.operators.stats import weighted_percentiles


def utilization_pairs(
    job_tasks: DataFrame,
    cores: int = CORES_PER_EXECUTOR,
    disks: tuple[str, ...] = UTILIZATION_DISKS,
) -> DataFrame:
    """(app_id, measure, value, weight): one row per task and measured device."""

    def entry(measure: str, value):
        return F.struct(F.lit(measure).alias("measure"), value.cast("double").alias("value"))

    rx = F.col("rx_Bps") / LINK_BYTES_PER_SECOND
    tx = F.col("tx_Bps") / LINK_BYTES_PER_SECOND
    always = F.array(
        entry("cpu_utilization", F.col("total_cpu") / float(cores)),
        entry("cpu_process_user_utilization", F.col("proc_user_cpu") / float(cores)),
        entry("cpu_process_system_utilization", F.col("proc_sys_cpu") / float(cores)),
        entry("network_utilization", rx),
        entry("network_utilization", tx),
        entry("network_utilization_recv", rx),
    )
    fetching = F.array(
        entry("network_utilization_fetch_only", rx), entry("network_utilization_fetch_only", tx)
    )
    per_disk = F.flatten(
        F.transform(
            F.filter(F.map_entries("disks"), lambda d: d["key"].isin(*disks)),
            lambda d: F.array(
                entry("disk_utilization", d["value"]["Disk Utilization"]),
                entry("disk_throughput", d["value"]["Read Throughput"] + d["value"]["Write Throughput"]),
            ),
        )
    )
    # A slice is compiled; a lambda over an array of entries is interpreted for every row.
    kept = F.when(F.col("has_fetch"), F.size(fetching)).otherwise(0)
    all_entries = F.concat(always, F.slice(fetching, F.lit(1), kept), per_disk)
    return job_tasks.select(
        "app_id", F.col("runtime_ms").alias("weight"), F.explode(all_entries).alias("e")
    ).select("app_id", "e.measure", "e.value", "weight")


def utilizations(job_tasks: DataFrame, rule: str = "reference", pieces: int | None = None) -> DataFrame:
    """Weighted percentiles and mean of every measure; a measure without rows has no row."""
    return weighted_percentiles(
        utilization_pairs(job_tasks), ["app_id", "measure"], rule=rule, pieces=pieces, cut_by="measure"
    )


def idle_fractions(utilization: DataFrame) -> DataFrame:
    """Box-plot figures of idle time: one minus the percentiles of the three main measures."""
    return utilization.where(
        F.col("measure").isin("cpu_utilization", "disk_utilization", "network_utilization")
    ).select(
        "app_id",
        "measure",
        (1 - F.col("p25")).alias("box_low"),
        (1 - F.col("p5")).alias("whisker_low"),
        (1 - F.col("p95")).alias("whisker_high"),
        (1 - F.col("p75")).alias("box_high"),
        (1 - F.col("p50")).alias("middle"),
    )
