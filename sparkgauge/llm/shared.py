"""What the operators share: tables in the shared folder, Arrow batches of bounded size."""

import functools
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.session import materialize

# Texts are worked on in runs of about this many bytes; one longer text is a run of its own.
RUN_BYTES = 1 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below spark.checkpoint.dir and read it back: cuts lineage, survives executors."""
    return materialize(df, name)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def runs(batch: pa.RecordBatch, column: str, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about `limit` bytes each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    column: str = "text",
) -> DataFrame:
    """Apply `work` to runs of rows inside the tasks that read them; no shuffle."""

    def mapper(batches):
        for batch in batches:
            for run in runs(batch, column):
                yield work(run)

    return df.mapInArrow(mapper, schema)


#: Ids up to which a lookup side goes out as a broadcast (8 MB of longs); more are shuffled.
BROADCAST_IDS = 1_000_000


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` is among the distinct `ids`. The ids are counted first: only
    up to BROADCAST_IDS of them are broadcast, so that a table of texts need not move."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


#: Cells of a bit map of keys, of 64 bits each, and cells in a row of its broadcast: 4 MB at any size.
CELLS, CELLS_A_ROW = 1 << 19, 1 << 10


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """(part, bits): a bit map of the keys, as a table of arrays of CELLS_A_ROW longs.

    Whole arrays, also where no bit is set: as a row for each cell, the driver would hold the hash
    table of the broadcast several times its size while it is made.
    """
    place = F.pmod(F.xxhash64(key), F.lit(64 * CELLS))
    bit = F.expr("shiftleft(1L, int(place & 63))").alias("bits")
    held = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("cell"), bit)
    empty = keys.sparkSession.range(CELLS).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bits"))
    cells = held.unionByName(empty).groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    in_order = F.sort_array(F.collect_list(F.struct("cell", "bits")))["bits"].alias("bits")
    return stage(cells.groupBy(F.floor(F.col("cell") / CELLS_A_ROW).alias("part")).agg(in_order), "key_bits")


def maybe_of(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` may be among the `keys`, null keys not: those of other keys are few, as long as
    the keys are few beside the bits of the map. No row is moved, and the driver gets the map only."""
    bits = key_bits(keys, key).select(F.col("part").alias("_part"), F.col("bits").alias("_bits"))
    place = F.pmod(F.xxhash64(key), F.lit(64 * CELLS))
    placed = df.where(F.col(key).isNotNull()).withColumn("_place", place)
    placed = placed.withColumn("_part", F.floor(F.col("_place") / (64 * CELLS_A_ROW)))
    cell = F.get("_bits", F.pmod(F.shiftright("_place", 6), F.lit(CELLS_A_ROW)).cast("int"))
    told = placed.join(F.broadcast(bits), "_part").withColumn("_cell", cell)
    return told.where(F.expr("shiftright(_cell, int(_place & 63)) & 1") == 1).select(*df.columns)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose `key` is not among the distinct `ids`; nulls stay."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, "left_anti")


@functools.lru_cache(4)
def _ship(application: str) -> str:
    """Zip of the library, for the Python workers of one application."""
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="package-")) / "sparkgauge_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((root / "sparkgauge").rglob("*.py")):
            out.write(file, file.relative_to(root))
    return str(path)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder. Python workers get this library through Spark's own file
    distribution, so that it need not be installed on them."""
    context = spark.sparkContext
    if not any(f.endswith("sparkgauge_package.zip") for f in context.listFiles):
        context.addPyFile(_ship(context.applicationId))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
