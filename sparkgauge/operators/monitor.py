"""Machine time series from monitor samples."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.constants import (
    BYTES_PER_GIB,
    BYTES_PER_GIBIT,
    BYTES_PER_MB,
    CORES_PER_EXECUTOR,
)
from sparkgauge.functions.units import last_path_part
from sparkgauge.operators.joins import salted_join
from sparkgauge.operators.ordered import Running, ordered_scan
from sparkgauge.operators.tasks import merge_maps
from sparkgauge.schemas import MONITOR_DISK

# Input keys of the gauges and the names they get here (fixed by the log format).
GAUGES = {
    "Running Compute Monotasks": "running_compute",
    "Running Macrotasks": "running_tasks",
    "Local Running Macrotasks": "local_running_tasks",
    "Macrotasks In Network": "tasks_in_network",
    "Macrotasks In Compute": "tasks_in_compute",
    "Macrotasks In Disk": "tasks_in_disk",
    "Running Low Priority Network Monotasks": "low_priority_network",
}
QUEUES = {
    "Running And Queued Monotasks": "running",
    "Queued Read Monotasks": "queued_reads",
    "Queued Remove Monotasks": "queued_removes",
    "Queued Write Monotasks": "queued_writes",
}


def is_physical_disk(name: Column) -> Column:
    """Not a RAM disk or system mount; of the `sd` disks only `sdb` and `sda1`."""
    return (
        ~name.contains("ram")
        & ~name.contains("xvda1")
        & (~name.contains("sd") | name.isin("sdb", "sda1"))
    )


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def finite_samples(samples: DataFrame) -> DataFrame:
    """Drop ticks whose receive rate, transmit rate or CPU use is not a number."""
    net, cpu = F.col("sample.`Network Utilization`"), F.col("sample.`Cpu Utilization`")
    return samples.where(
        _finite(net["Bytes Received Per Second"])
        & _finite(net["Bytes Transmitted Per Second"])
        & _finite(cpu["Total User Utilization"] + cpu["Total System Utilization"])
    )


def with_relative_time(samples: DataFrame) -> DataFrame:
    """Add `time`: millis since the first tick of the file, counted before any tick is dropped."""
    starts = samples.groupBy("host").agg(
        F.min_by(F.col("sample.`Current Time`"), "pos").alias("start_ms")
    )
    return (
        salted_join(samples, starts, ["host"], ["pos"])
        .withColumn("time", F.col("sample.`Current Time`") - F.col("start_ms"))
        .drop("start_ms")
    )


def monitor_samples(samples: DataFrame, cores: int = CORES_PER_EXECUTOR) -> DataFrame:
    """One row per tick from (host, pos, time, sample); absent gauges are 0."""
    s = F.col("sample")
    cpu, net = s["Cpu Utilization"], s["Network Utilization"]
    system = cpu["Total System Utilization"]

    def gauge(key: str) -> Column:
        return F.coalesce(s[key], F.lit(0).cast("long"))

    return samples.select(
        "host",
        "pos",
        "time",
        ((cpu["Total User Utilization"] + system) / float(cores)).alias("cpu_utilization"),
        (system / float(cores)).alias("cpu_system"),
        (net["Bytes Received Per Second"] / BYTES_PER_GIBIT).alias("bytes_received"),
        (net["Bytes Transmitted Per Second"] / BYTES_PER_GIBIT).alias("bytes_transmitted"),
        *[gauge(key).alias(name) for key, name in GAUGES.items()],
        F.coalesce(s["Fraction GC Time"], F.lit(0.0)).alias("gc_fraction"),
        F.floor(gauge("Outstanding Network Bytes") / float(BYTES_PER_MB)).alias("outstanding_network_mb"),
        (gauge("Free Heap Memory Bytes") / float(BYTES_PER_GIB)).alias("free_heap_gib"),
        (gauge("Free Off-Heap Memory Bytes") / float(BYTES_PER_GIB)).alias("free_off_heap_gib"),
        gauge("Total Started Macrotasks").alias("total_started"),
        s["Total Started Macrotasks"].isNotNull().alias("has_total_started"),
    )


def monitor_disks(samples: DataFrame) -> DataFrame:
    """One row per tick and physical disk, with the disk's queue gauges (0 when not listed)."""
    maps = F.col("sample.`Disk Utilization`.`Device Name To Utilization`")
    empty = F.create_map().cast(T.MapType(T.StringType(), MONITOR_DISK))
    rows = samples.select(
        "host", "pos", "time", "sample", F.explode(merge_maps(maps, empty)).alias("disk", "usage")
    ).where(is_physical_disk(F.col("disk")))
    # The queue list is short and sits in the same row: looked up without a join.
    queue = F.try_element_at(
        F.filter(
            F.col("sample.`Running Disk Monotasks`"),
            lambda q: last_path_part(q["Disk Name"]) == F.col("disk"),
        ),
        F.lit(-1),
    )
    return rows.select(
        "host",
        "pos",
        "time",
        "disk",
        F.col("usage.`Disk Utilization`").alias("utilization"),
        F.col("usage.`Read Throughput`").alias("read_Bps"),
        F.col("usage.`Write Throughput`").alias("write_Bps"),
        *[
            F.coalesce(queue[key], F.lit(0).cast("long")).alias(name)
            for key, name in QUEUES.items()
        ],
    )


def started_deltas(
    ticks: DataFrame, order: list[str] | None = None, cut_on: str | None = None, pieces: int | None = None
) -> DataFrame:
    """(host, time, delta): tasks started since the highest count so far, where more than 0."""
    order = order or ["pos"]
    needed = dict.fromkeys(["host", "pos", "time", "total_started", *order, cut_on or "pos"])
    counted = ticks.where("has_total_started").select(*needed)
    scan = ordered_scan(
        counted,
        ["host"],
        order,
        {"_highest": Running("max", F.col("total_started"))},
        pieces=pieces,
        cut_on=cut_on,
    )
    delta = F.col("total_started") - F.greatest(F.lit(0).cast("long"), F.col("_highest"))
    return scan.rows.select("host", "pos", "time", delta.alias("delta")).where(F.col("delta") > 0)


def spikes(deltas: DataFrame) -> DataFrame:
    """Three points per delta, so that a line plot shows a vertical bar."""
    points = F.array(F.lit(0).cast("long"), F.col("delta"), F.lit(0).cast("long"))
    return deltas.select("host", "pos", "time", F.posexplode(points).alias("point", "height"))


# Which series belong together (fixed by the reports).
PANELS = {
    "memory": ["free_heap_gib", "free_off_heap_gib"],
    "tasks": [
        "local_running_tasks", "tasks_in_network", "tasks_in_compute", "tasks_in_disk",
        "running_tasks", "gc_fraction", "outstanding_network_mb",
    ],
    "utilization": [
        "cpu_utilization", "bytes_received", "bytes_transmitted", "cpu_system", "gc_fraction",
    ],
}
DISK_PANELS = {
    "disk": ["utilization", "write_Bps", "read_Bps"],
    "one_disk": ["running", "write_Bps", "read_Bps", "utilization"],
}
# The GC fraction is drawn on the scale of the cores in the task panel.
GC_SCALE = 8.0


def _long(rows: DataFrame, keep: list[str], panels: dict) -> DataFrame:
    points = []
    for panel, names in panels.items():
        for name in names:
            value = F.col(name).cast("double")
            if (panel, name) == ("tasks", "gc_fraction"):
                value = value * GC_SCALE
            points.append(
                F.struct(F.lit(panel).alias("panel"), F.lit(name).alias("metric"), value.alias("value"))
            )
    return rows.select(*keep, F.explode(F.array(*points)).alias("p")).select(*keep, "p.*")


def monitor_panels(ticks: DataFrame, disks: DataFrame) -> DataFrame:
    """Long table (host, time, panel, disk, metric, value) of every panel."""
    whole = _long(ticks.withColumn("disk", F.lit(None).cast("string")), ["host", "pos", "time", "disk"], PANELS)
    per_disk = _long(disks, ["host", "pos", "time", "disk"], {**DISK_PANELS, "utilization": ["utilization"]})
    return whole.unionByName(per_disk)


def series(panels: DataFrame, metric: str, disk: str | None = None) -> DataFrame:
    """One metric over time, of one disk if given."""
    chosen = panels.where(F.col("metric") == metric)
    return chosen if disk is None else chosen.where(F.col("disk") == disk)
