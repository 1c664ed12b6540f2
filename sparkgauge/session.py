"""Session settings and durable intermediates."""

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Shuffle files go when the job that wrote them ends, not when the driver next collects garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of a table that a task writes to at a time; beyond these it sorts its rows by folder.
WRITERS_CONF, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", "8"
#: Tables written in the innermost scratch() block: folder of each, by the id of its frame.
_WRITTEN: ContextVar[dict[int, tuple[str, DataFrame]] | None] = ContextVar("_WRITTEN", default=None)


def local_session(cores="*", app_name="sparkgauge", shuffle_partitions=8, extra=None):
    """Session for tests and benchmarks on one machine. On a cluster use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: the one the cluster names in spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a folder of its own; on a cluster that
    would lose data, so it is an error.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/sparkgauge/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_run(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Frames built on them end with it."""
    _delete(spark, run_dir(spark))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that the block materializes once it ends, but for those given to `keep`.

    `with scratch() as keep: links = keep(materialize(...))`. Only frames that `materialize`
    returned can be kept, and nothing that lives on may read another table of the block. What an
    inner block keeps belongs to the outer one.
    """
    written: dict[int, tuple[str, DataFrame]] = {}
    kept: set[int] = set()

    def keep(table: DataFrame) -> DataFrame:
        if id(table) not in written:
            raise ValueError("only tables that were written in this block can be kept")
        kept.add(id(table))
        return table

    outer = _WRITTEN.get()
    token = _WRITTEN.set(written)
    try:
        yield keep
    finally:
        _WRITTEN.reset(token)
        for key, (folder, table) in written.items():
            if key not in kept:
                _delete(table.sparkSession, folder)
            elif outer is not None:
                outer[key] = (folder, table)


def materialize(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts lineage durably (a lost executor re-reads files), keeps column pruning, and gives
    the planner true file sizes, so broadcast decisions are made from a checked size. Zstandard
    takes a fraction of the disk of the default codec for text and wide rows. The shuffles behind
    the table are nobody else's (a frame is planned anew each time it is run), so they are removed
    once it is written. Rows of a table in few folders are not sorted. The settings are the caller's again after that.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    during = {CLEANUP_CONF: "true"} | ({WRITERS_CONF: WRITERS} if partition_by else {})
    before = {key: spark.conf.get(key, None) for key in during}
    for key, value in during.items():
        spark.conf.set(key, value)
    try:
        writer.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written[id(table)] = (path, table)
    return table
