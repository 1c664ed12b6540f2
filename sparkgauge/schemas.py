"""Schemas of the input logs. Key names are fixed by the log format.

Everything is nullable: logs come from different writers and leave sections out.
"""

from pyspark.sql import types as T

LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()


def fields(*pairs):
    """StructType from (name, type) pairs."""
    return T.StructType([T.StructField(name, dtype) for name, dtype in pairs])


def with_corrupt(schema):
    """The schema with the column that keeps the text of a line that is not whole JSON."""
    return T.StructType([*schema.fields, T.StructField("_corrupt", STRING)])


DISK_COUNTERS = fields(
    ("Sectors Read", LONG),
    ("Millis Reading", LONG),
    ("Sectors Written", LONG),
    ("Millis Writing", LONG),
    ("Millis Total", LONG),
)

TASK_DISK = fields(
    ("Disk Utilization", DOUBLE),
    ("Read Throughput", DOUBLE),
    ("Write Throughput", DOUBLE),
    ("Start Counters", DISK_COUNTERS),
    ("End Counters", DISK_COUNTERS),
)

CPU_COUNTERS = fields(
    ("Total User Jiffies", LONG),
    ("Total System Jiffies", LONG),
    ("Time Milliseconds", LONG),
)

NETWORK_COUNTERS = fields(("Transmitted Bytes", LONG))

TASK_INFO = fields(
    ("Task ID", LONG),
    ("Launch Time", LONG),
    ("Finish Time", LONG),
    ("Host", STRING),
    ("Executor ID", STRING),
    ("Locality", STRING),
    ("Failed", T.BooleanType()),
    ("Speculative", T.BooleanType()),
)

TASK_METRICS = fields(
    ("Executor Run Time", LONG),
    ("Executor Deserialize Time", LONG),
    ("Executor CPU Time", LONG),
    ("Result Serialization Time", LONG),
    ("JVM GC Time", LONG),
    ("JVM GC Time Total", LONG),
    ("Disk Nanos", LONG),
    ("Computation Nanos", LONG),
    ("Disk Bytes Spilled", LONG),
    (
        "Disk Utilization",
        fields(
            (
                "Device Name To Utilization",
                T.ArrayType(T.MapType(STRING, TASK_DISK)),
            )
        ),
    ),
    ("Start Network Transmit Total Idle Millis", DOUBLE),
    ("End Network Transmit Total Idle Millis", DOUBLE),
    (
        "Network Utilization",
        fields(
            ("Start Counters", NETWORK_COUNTERS),
            ("End Counters", NETWORK_COUNTERS),
            ("Bytes Transmitted Per Second", DOUBLE),
            ("Bytes Received Per Second", DOUBLE),
        ),
    ),
    (
        "Cpu Utilization",
        fields(
            ("Process User Utilization", DOUBLE),
            ("Process System Utilization", DOUBLE),
            ("Total User Utilization", DOUBLE),
            ("Total System Utilization", DOUBLE),
            ("Start Counters", CPU_COUNTERS),
            ("End Counters", CPU_COUNTERS),
        ),
    ),
    ("HDFS Deserialization/Decompression Millis", DOUBLE),
    ("HDFS Serialization/Compression Millis", DOUBLE),
    (
        "Shuffle Write Metrics",
        fields(
            ("Shuffle Write Time", LONG),
            ("Shuffle Open Time", LONG),
            ("Shuffle Close Time", LONG),
            ("Shuffle Bytes Written", LONG),
        ),
    ),
    (
        "Input Metrics",
        fields(
            ("Read Time Nanos", LONG),
            ("Data Read Method", STRING),
            ("Hadoop Bytes Read", LONG),
            ("Bytes Read", LONG),
        ),
    ),
    ("Output Write Blocked Nanos", LONG),
    ("Output Bytes", LONG),
    (
        "Updated Blocks",
        T.ArrayType(fields(("Status", fields(("Memory Size", LONG))))),
    ),
    (
        "Shuffle Read Metrics",
        fields(
            ("Fetch Wait Time", LONG),
            ("Local Blocks Fetched", LONG),
            ("Remote Blocks Fetched", LONG),
            ("Remote Bytes Read", LONG),
            ("Local Bytes Read", LONG),
            ("Local Read Time", LONG),
        ),
    ),
)

TASK_END = fields(
    ("Event", STRING),
    ("Stage ID", LONG),
    ("Task Info", TASK_INFO),
    ("Task Metrics", TASK_METRICS),
)

JOB_START = fields(
    ("Event", STRING),
    ("Job ID", LONG),
    ("Submission Time", LONG),
    ("Stage IDs", T.ArrayType(LONG)),
    (
        "Stage Infos",
        T.ArrayType(fields(("Stage ID", LONG), ("Stage Name", STRING))),
    ),
)

MONITOR_DISK = fields(
    ("Disk Utilization", DOUBLE),
    ("Read Throughput", DOUBLE),
    ("Write Throughput", DOUBLE),
)

MONITOR_SAMPLE = fields(
    ("Current Time", LONG),
    (
        "Disk Utilization",
        fields(
            (
                "Device Name To Utilization",
                T.ArrayType(T.MapType(STRING, MONITOR_DISK)),
            )
        ),
    ),
    (
        "Cpu Utilization",
        fields(
            ("Total User Utilization", DOUBLE),
            ("Total System Utilization", DOUBLE),
        ),
    ),
    (
        "Network Utilization",
        fields(
            ("Bytes Received Per Second", DOUBLE),
            ("Bytes Transmitted Per Second", DOUBLE),
        ),
    ),
    (
        "Running Disk Monotasks",
        T.ArrayType(
            fields(
                ("Disk Name", STRING),
                ("Running And Queued Monotasks", LONG),
                ("Queued Read Monotasks", LONG),
                ("Queued Remove Monotasks", LONG),
                ("Queued Write Monotasks", LONG),
            )
        ),
    ),
    ("Running Compute Monotasks", LONG),
    ("Running Macrotasks", LONG),
    ("Local Running Macrotasks", LONG),
    ("Macrotasks In Network", LONG),
    ("Macrotasks In Compute", LONG),
    ("Macrotasks In Disk", LONG),
    ("Running Low Priority Network Monotasks", LONG),
    ("Total Started Macrotasks", LONG),
    ("Fraction GC Time", DOUBLE),
    ("Outstanding Network Bytes", LONG),
    ("Free Heap Memory Bytes", LONG),
    ("Free Off-Heap Memory Bytes", LONG),
)

#: Kind and task of an event, for counts: the line is still parsed to its end.
TASK_IDS = fields(("Event", STRING), ("Task Info", fields(("Task ID", LONG))))
