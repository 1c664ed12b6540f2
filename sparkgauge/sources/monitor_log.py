"""Periodic utilization logs: one JSON object per sampling tick, one file per executor."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge import schemas
from sparkgauge.operators.joins import salted_join
from sparkgauge.session import materialize
from sparkgauge.sources.event_log import JSON_OPTIONS, file_position, whole

MONITOR_FILES = "*executor_monitor"


def read_monitor_lines(spark: SparkSession, paths, pattern: str = MONITOR_FILES) -> DataFrame:
    """(host, pos, value) of the monitor files in some directories; `host` is the file."""
    reader = spark.read.option("pathGlobFilter", pattern)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("host"),
        file_position(F.lit(0).cast("long")).alias("pos"),
        "value",
    )


def decode_samples(lines: DataFrame) -> DataFrame:
    """(host, pos, sample, ok): ok if the line is whole JSON; a field of another type than
    declared is NULL."""
    schema = schemas.with_corrupt(schemas.MONITOR_SAMPLE)
    sample = F.struct("value", F.from_json("value", schema, JSON_OPTIONS).alias("sample"))
    decoded = lines.select("host", "pos", F.inline(F.array(sample)))
    ok = F.col("sample").isNotNull() & whole(F.col("value"), F.col("sample._corrupt"))
    return decoded.select("host", "pos", "sample", ok.alias("ok"))


def whole_samples(decoded: DataFrame, staged: bool = True) -> DataFrame:
    """Samples before the first broken line of their file.

    Lines that are not JSON are skipped at the beginning of a file; after the first sample the
    first one that is not JSON ends the file (the writer was cut off there). The decoded lines
    are read several times, here and for relative times, so they are `staged` as a table.
    """
    if staged:
        decoded = materialize(decoded, "samples")
    first = decoded.groupBy("host").agg(F.min(F.when(F.col("ok"), F.col("pos"))).alias("first_good"))
    bad = decoded.where(~F.col("ok")).select("host", F.col("pos").alias("bad_pos"))
    stop = (
        salted_join(bad, first, ["host"], ["bad_pos"])
        .where(F.col("bad_pos") > F.col("first_good"))
        .groupBy("host")
        .agg(F.min("bad_pos").alias("stop"))
    )
    good = decoded.where("ok").drop("ok")
    return (
        salted_join(good, stop, ["host"], ["pos"], how="left")
        .where(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
        .drop("stop")
    )
