"""Waterfall of small work units from a text log: islands of a stage and lanes inside them."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgauge.operators.joins import salted_join
from sparkgauge.operators.ordered import PIECE, add_piece, row_numbers
from sparkgauge.session import materialize
from sparkgauge.sources.event_log import file_position

NETWORK, COMPUTE = 1, 2
# 0-based positions of the space-separated fields (fixed by the log format).
TASK_FIELD, STAGE_FIELD, RUNTIME_FIELD, START_FIELD = 9, 12, 15, 19


def read_work_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, pos, value)."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        file_position(F.lit(0).cast("long")).alias("pos"),
        "value",
    )


def parse_work_lines(lines: DataFrame, offset: int = 0) -> DataFrame:
    """(file, pos, kind, id, stage_id, start_ms, runtime_ms) of every line; kind NULL = neither.

    `offset` shifts the fields when the log carries extra leading ones. The start loses its
    last three characters; where it ends the line, the line feed is one of them, so two that
    can be seen.
    """
    # The one-element generator keeps a line from being made and split again for every field and
    # for every filter that is pushed below the fields.
    once = F.struct("value", F.split("value", " ").alias("items"))
    lines = lines.select("file", "pos", F.inline(F.array(once)))
    items = F.col("items")

    def field(position: int) -> Column:
        return F.try_element_at(items, F.lit(offset + position + 1))

    start = field(START_FIELD)
    cut = F.when(F.size(items) == offset + START_FIELD + 1, 2).otherwise(3)
    value = F.col("value")
    kind = F.when(value.contains("network") & ~value.contains("NetworkResponse"), NETWORK).when(
        value.contains("compute"), COMPUTE
    )
    owner = F.regexp_replace(field(STAGE_FIELD), "^[)}]+|[)}]+$", "").try_cast("bigint")
    parsed = lines.select(
        "file",
        "pos",
        kind.alias("kind"),
        field(TASK_FIELD).try_cast("bigint").alias("task_id"),
        owner.alias("owner"),
        F.substring(start, F.lit(1), F.greatest(F.length(start) - cut, F.lit(0)))
        .try_cast("bigint")
        .alias("start_ms"),
        field(RUNTIME_FIELD).try_cast("bigint").alias("runtime_ms"),
    )
    is_compute = F.col("kind") == COMPUTE
    return parsed.select(
        "file",
        "pos",
        "kind",
        F.when(is_compute, F.col("task_id")).otherwise(F.col("owner")).alias("id"),
        F.when(is_compute, F.col("owner")).alias("stage_id"),
        "start_ms",
        "runtime_ms",
    )


def unreadable_work_lines(parsed: DataFrame) -> DataFrame:
    """Compute and network lines without a readable owner, start or runtime: the quarantine."""
    return parsed.where(F.col("kind").isNotNull() & ~_readable())


def _readable() -> Column:
    return F.col("id").isNotNull() & F.col("start_ms").isNotNull() & F.col("runtime_ms").isNotNull()


def islands(
    parsed: DataFrame, order: list[str] | None = None, cut_on: str | None = None, pieces: int | None = None
) -> DataFrame:
    """Add `island`: a compute line of another stage than the last compute line opens a new one.

    Network lines join the open island; before any compute line the stage is 0. Unreadable
    lines (`unreadable_work_lines`) get no lane.
    """
    order = order or ["pos"]
    kept = parsed.where(F.col("kind").isNotNull() & _readable())
    rows = kept if PIECE in kept.columns else add_piece(kept, cut_on or order[0], pieces)
    # Inside a piece: changes after its first compute line, and whether that line has come yet.
    here = Window.partitionBy("file", PIECE).orderBy(*order)
    before = F.last("stage_id", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    to_here = here.rowsBetween(Window.unboundedPreceding, 0)
    changed = F.coalesce((F.col("stage_id") != F.col("_before")).cast("long"), F.lit(0).cast("long"))
    scanned = rows.withColumn("_before", before).select(
        *rows.columns,
        F.sum(changed).over(to_here).alias("_changes"),
        (F.count("stage_id").over(to_here) > 0).alias("_begun"),
    )
    # A piece's state is (first stage, last stage, changes). Two neighbours combine to (first of the
    # left, last of the right, both changes and one more if last and first differ), whatever the
    # grouping, so what comes before a piece is a running value over one small row per piece.
    at = F.when(F.col("stage_id").isNotNull(), F.struct(*order))
    states = scanned.groupBy("file", PIECE).agg(
        F.min_by("stage_id", at).alias("_first"),
        F.max_by("stage_id", at).alias("_last"),
        F.max("_changes").alias("_inside"),
    )
    earlier = Window.partitionBy("file").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    entered = F.coalesce(
        (F.col("_first") != F.coalesce(F.last("_last", ignorenulls=True).over(earlier), F.lit(0))).cast("long"),
        F.lit(0).cast("long"),
    )
    states = states.withColumn("_entered", entered)
    carried = states.select(
        "file",
        PIECE,
        "_entered",
        F.coalesce(F.sum(F.col("_inside") + F.col("_entered")).over(earlier), F.lit(0)).alias("_carried"),
    )
    island = F.col("_carried") + F.col("_changes") + F.when(F.col("_begun"), F.col("_entered")).otherwise(0)
    return scanned.join(carried, ["file", PIECE]).select(*kept.columns, island.alias("island"))


def waterfall(
    parsed: DataFrame, order: list[str] | None = None, cut_on: str | None = None, pieces: int | None = None
) -> DataFrame:
    """(file, island, lane, kind, id, start, runtime_ms): lanes ordered by start.

    `start` counts from the first line of the file, whatever kind that line is.
    """
    order = order or ["pos"]
    # Read three times: for the first starts, to sample the ranges and to deal the rows to them.
    parsed = materialize(parsed, "parsed_lines")
    first = parsed.groupBy("file").agg(
        F.min_by("start_ms", F.struct(*order)).alias("first_start")
    )
    # Ranging by start samples its input, so the islands are written first.
    laned = row_numbers(
        materialize(islands(parsed, order, cut_on, pieces), "islands"),
        ["file", "island"],
        ["start_ms", *order],
        "lane",
        pieces=pieces,
    )
    return salted_join(laned, first, ["file"], ["start_ms", "lane"]).select(
        "file",
        "island",
        (F.col("lane") - 1).alias("lane"),
        "kind",
        "id",
        (F.col("start_ms") - F.col("first_start")).alias("start"),
        "runtime_ms",
    )


def waterfall_extent(lanes: DataFrame) -> DataFrame:
    """(file, last_end, max_lanes, max_lanes_ref): the latter leaves the last island out."""
    sizes = lanes.groupBy("file", "island").agg(
        F.max(F.col("start") + F.col("runtime_ms")).alias("end"),
        F.count(F.lit(1)).alias("lanes"),
    )
    last = sizes.groupBy("file").agg(
        F.greatest(F.lit(0), F.max("end")).alias("last_end"),
        F.max("lanes").alias("max_lanes"),
        F.max("island").alias("last_island"),
    )
    earlier = (
        salted_join(sizes, last.select("file", "last_island"), ["file"], ["island"])
        .where(F.col("island") < F.col("last_island"))
        .groupBy("file")
        .agg(F.max("lanes").alias("max_lanes_ref"))
    )
    return last.drop("last_island").join(earlier, ["file"], "left").withColumn(
        "max_lanes_ref", F.coalesce("max_lanes_ref", F.lit(0).cast("long"))
    )
