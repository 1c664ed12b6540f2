"""Report text of executor metrics, and writers."""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.functions.units import bits_text, bytes_text


# The labels, units and digits below are those of the report format.
def _metrics_text() -> Column:
    disk_lines = F.transform(
        "disks",
        lambda d: F.concat(
            d["disk"],
            F.lit(" disk metrics:\n\tdata transferred (read,written): "),
            bytes_text(d["bytes_read"]),
            F.lit(" , "),
            bytes_text(d["bytes_written"]),
            F.format_string(
                "\n\tutilization: %.2f%%\n\teffective throughput: ",
                F.try_divide(d["millis_total"] * 100.0, F.col("elapsed_ms")),
            ),
            bytes_text(d["effective_Bps"]),
            F.lit("/s\n"),
        ),
    )
    rate = F.col("tx_effective_Bps")
    return F.concat(
        F.format_string(
            "time (start,elapsed,end): %d ms, %d ms, %d ms\nnum tasks: %d\n",
            "start_ms", "elapsed_ms", "end_ms", "n_tasks",
        ),
        F.format_string(
            "cpu metrics:\n\tutilization: %.2f%%\n\tHDFS deser/decomp , ser/comp: %.2f s , %.2f s\n",
            F.col("cpu_utilization") * 100,
            F.col("hdfs_deser_ms") / 1000,
            F.col("hdfs_ser_ms") / 1000,
        ),
        F.lit("network metrics:\n\tdata transmitted: "),
        F.coalesce(bytes_text(F.col("tx_bytes")), F.lit("unknown")),
        F.format_string("\n\ttransmit utilization: %.2f%%", F.col("tx_utilization") * 100),
        F.lit("\n\teffective transmit throughput: "),
        F.coalesce(
            F.concat(bits_text(rate * 8), F.lit("/s ("), bytes_text(rate), F.lit("/s)")),
            F.lit("unknown"),
        ),
        F.lit("\n"),
        F.array_join(disk_lines, ""),
        F.format_string("GC millis: %d\n", "gc_ms"),
    )


def stage_report_text(metrics: DataFrame) -> DataFrame:
    """(app_id, job_id, stage_id, executor_id, text), in report order."""
    title = F.format_string(
        "Job %d, Stage %d, Executor %s (%s):\n", "job_id", "stage_id", "executor_id", "host"
    )
    return metrics.select(
        "app_id", "job_id", "stage_id", "executor_id", F.concat(title, _metrics_text()).alias("text")
    ).orderBy("app_id", "job_id", "stage_id", "executor_id")


def job_report_text(metrics: DataFrame, disks: DataFrame) -> DataFrame:
    """(app_id, job_id, executor_id, text), in report order.

    The few disks of an executor are gathered into its row.
    """
    keys = ["app_id", "job_id", "executor_id"]
    parts = F.struct("disk", "bytes_read", "bytes_written", "millis_total", "effective_Bps")
    gathered = disks.groupBy(*keys).agg(F.sort_array(F.collect_list(parts)).alias("disks"))
    title = F.format_string("Job %d, Executor %s (%s):\n", "job_id", "executor_id", "host")
    joined = metrics.join(gathered, keys, "left").withColumn(
        "disks", F.coalesce("disks", F.array().cast(gathered.schema["disks"].dataType))
    )
    return joined.select(*keys, F.concat(title, _metrics_text()).alias("text")).orderBy(*keys)


def ideal_stage_text(models: DataFrame) -> DataFrame:
    """Ideal-time report lines of each stage."""
    text = F.format_string(
        "Job %d, Stage %d:\n\tcpu: %.2f s\n\tcpu (only ser / deser): %.2f s\n"
        "\tnetwork: %.2f s (%.6f mb)\n\tdisk: %.2f s\n\tactual: %.2f s\n",
        "job_id", "stage_id", "ideal_cpu_s", "ser_deser_s", "ideal_network_s", "network_mb",
        "ideal_disk_s", F.col("runtime_ms") / 1000.0,
    )
    return models.select("app_id", "job_id", "stage_id", text.alias("text"))


def ideal_job_text(jobs: DataFrame) -> DataFrame:
    text = F.format_string(
        "Job %d ideal runtime: %.2f s\nJob %d actual runtime: %.2f s\n"
        "Job %d total stage runtime: %.2f s\n",
        "job_id", "ideal_s", "job_id", "actual_s", "job_id", "total_stage_s",
    )
    return jobs.select("app_id", "job_id", text.alias("text"))


def write_rows(
    df: DataFrame, path: str, partition_by=(), header: bool = True, mode: str = "errorifexists"
) -> None:
    """Tab-separated files, one directory per value of `partition_by`. Complex columns as JSON."""
    flat = df.select(
        *[
            F.to_json(f.name).alias(f.name)
            if f.dataType.typeName() in ("array", "map", "struct")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    writer = flat.write.mode(mode).option("sep", "\t").option("header", header)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def append_rows(df: DataFrame, path: str, run_id: str) -> None:
    """Rows of one run beside those of others. A repeated append of a run replaces its rows."""
    write_rows(df, f"{path}/run={run_id}", header=False, mode="overwrite")


MANIFEST = "manifest"


def write_report(outputs: dict[str, DataFrame], path: str, run_id: str) -> None:
    """All outputs of a run below path/run_id, with a manifest that is written last: a run without
    one is not complete. A repeated write takes the manifest away first and replaces everything."""
    spark = next(iter(outputs.values())).sparkSession
    folder = f"{path}/{run_id}"
    manifest = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(manifest, True)
    for name, df in outputs.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
    listed = [(name, df.schema.json()) for name, df in outputs.items()]
    rows = spark.createDataFrame(listed, "name string, fields string")
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/{MANIFEST}")


def read_report(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """The outputs of a complete run."""
    folder = f"{path}/{run_id}"
    try:
        listed = spark.read.schema("name string, fields string").json(f"{folder}/{MANIFEST}").collect()
    except AnalysisException as missing:
        raise ValueError(f"run {run_id} below {path} is not complete") from missing
    return {
        r.name: spark.read.schema(T.StructType.fromJson(json.loads(r.fields))).parquet(f"{folder}/{r.name}")
        for r in listed
    }
