"""Unit factors, device ceilings and disk lists the results depend on."""

# Unit factors.
MILLIS_PER_JIFFY = 10
BYTES_PER_SECTOR = 512
BYTES_PER_MB = 1048576
BYTES_PER_GIB = 1024 * 1024 * 1024
NANOS_PER_MILLI = 1000000.0

# A gigabit as the task-utilization distribution counts it (decimal) and as the
# ideal-time models and the monitor count it (binary), both in bytes.
LINK_BYTES_PER_SECOND = 1.0e9 / 8
BYTES_PER_GIBIT = 1024 * 1024 * 1024 / 8.0

# Device ceilings.
NETWORK_GBPS = 0.7
NETWORK_GBPS_MEASURED = 0.917
NETWORK_GBPS_SORT = 0.6
DISK_BYTES_PER_SECOND = 80e6
CORES_PER_EXECUTOR = 8

# Disks that count for the utilization distributions and for the models.
UTILIZATION_DISKS = ("xvdb", "xvdf")
MODEL_DISKS = ("xvdb", "xvdc", "xvdf")

# Percentiles of the plain summary and of the weighted distribution.
SUMMARY_PERCENTILES = (5, 25, 50, 75, 95)
WEIGHTED_PERCENTILES = (5, 25, 50, 75, 95, 99)

# Executor counters may differ from task metrics by this fraction before a flag is set.
COUNTER_TOLERANCE = 0.1

# A stage longer than this may be the "last significant" one.
SIGNIFICANT_STAGE_MS = 1000
