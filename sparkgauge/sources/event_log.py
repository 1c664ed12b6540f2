"""Event-log source: one JSON object per line, many applications at once."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge import schemas
from sparkgauge.operators.joins import salted_join
from sparkgauge.session import materialize

# Row numbers restart in every scan partition, byte offsets in every file. A log beyond these
# limits is an error, never a wrong order.
FILE_STRIDE = 1 << 40
SPLIT_ROWS = 1 << 33


def file_position(file_number: Column) -> Column:
    """Order of a line inside its application as one long.

    A split starts at byte `file_block_start` and every line takes more than one byte, so
    start + row number grows with the line and never reaches the next split. Rolled logs add
    the file number on top. Evaluate directly over the scan, before any filter or shuffle.
    """
    # The upper bits hold the number of the scan partition, or one more if the rows overflow.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(SPLIT_ROWS - 1))
    partition = F.shiftright(F.monotonically_increasing_id(), 33)
    start = F.col("_metadata.file_block_start").cast("long")
    fits = (start + row < FILE_STRIDE) & (partition == F.spark_partition_id())
    message = "a log file over 1 TiB or a scan partition over 2^33 lines has no order here"
    return F.when(fits, file_number * F.lit(FILE_STRIDE) + start + row).otherwise(
        F.raise_error(F.lit(message)).cast("long")
    )


def read_lines(spark: SparkSession, paths, **options) -> DataFrame:
    """(app_id, pos, value) of plain, gzip or zstd logs, rolled or single.

    `app_id` is the directory for rolled logs (`events_<n>_<app>`) and for files called
    `event_log`, else the file itself.
    """
    reader = spark.read.options(**options)
    path = F.col("_metadata.file_path")
    name = F.col("_metadata.file_name")
    rolled = F.regexp_extract(name, "^events_([0-9]+)_", 1)
    is_rolled = rolled != ""
    folder = F.regexp_replace(path, "/[^/]+$", "")
    return reader.text(paths).select(
        F.when(is_rolled | (name == "event_log"), folder).otherwise(path).alias("app_id"),
        file_position(
            F.when(is_rolled, rolled.cast("long")).otherwise(F.lit(0).cast("long"))
        ).alias("pos"),
        "value",
    )


#: As the logs' own readers take it: bare NaN and Infinity, repeated keys (the last one counts).
JSON_OPTIONS = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}


def whole(value: Column, corrupt: Column | None = None) -> Column:
    """True for exactly one whole JSON object, whatever the types of its fields.

    Spark also keeps a text as `corrupt` when one field has another type than declared; that field
    is NULL then and the rest is good. So a corrupt text, as one that may hold two objects, is
    parsed again without types, as the only element of an array of plain maps.
    """
    alone = F.from_json(
        F.concat(F.lit("["), value, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"}
    )
    # Named once, and in a branch of its own: what is named twice is worked out for all lines, also
    # on the right of an AND or OR. The same goes for the blanks at the end, which few lines have.
    syntax = F.transform(alone, lambda fields: fields.isNotNull()) == F.array(F.lit(True))
    closed = F.when(value.endswith("}"), True).otherwise(F.rtrim(value, F.lit(" \t\r")).endswith("}"))
    if corrupt is not None:
        syntax = F.when(corrupt.isNull() & ~value.contains("}{"), True).otherwise(syntax)
    return F.when(closed, F.coalesce(syntax, F.lit(False))).otherwise(False)


def _parsed(schema, value: str | Column = "value") -> Column:
    return F.from_json(value, schemas.with_corrupt(schema), JSON_OPTIONS)


def _decode(lines: DataFrame, event_name: str, schema) -> DataFrame:
    # A test after the decoding would be pushed below it and decode every line again, so the
    # event is tested inside a one-element array.
    wanted = F.filter(
        F.array(_parsed(schema)),
        lambda e: whole(F.col("value"), e["_corrupt"]) & (e["Event"] == event_name),
    )
    # The text test is cheap and drops most lines before any JSON is parsed.
    return lines.where(F.col("value").contains(event_name)).select(
        "app_id", "pos", F.explode(wanted).alias("event")
    )


def task_end_events(lines: DataFrame, schema=schemas.TASK_END) -> DataFrame:
    """(app_id, pos, event) of finished tasks; other events and bad lines are left out.

    A narrower `schema` decodes less, for an analysis that needs few columns.
    """
    return _decode(lines, "SparkListenerTaskEnd", schema)


def task_end_events_of(lines: DataFrame, stages: DataFrame, schema=schemas.TASK_END) -> DataFrame:
    """`task_end_events` of some stages only, (app_id, stage_id), decoded in two steps.

    A job filter is known once the job starts are decoded. Of every task line only the kind and the
    stage are read then, the lines of other stages go, and the rest is decoded whole. `stages` should
    be a table: the planner knows its size and broadcasts it if that is small, so that no text
    moves; a stage with very many tasks is spread by salts otherwise.
    """
    ended = "SparkListenerTaskEnd"
    probe = schemas.fields(("Event", schemas.STRING), ("Stage ID", schemas.LONG))
    found = F.filter(F.array(_parsed(probe)), lambda e: e["Event"] == ended)
    staged = lines.where(F.col("value").contains(ended)).select(
        "app_id", "pos", "value", F.explode(found).alias("event")
    ).select("app_id", "pos", "value", F.col("event.Stage ID").alias("stage_id"))
    kept = salted_join(
        staged, stages.select("app_id", "stage_id").distinct(), ["app_id", "stage_id"], ["pos"], how="left_semi"
    )
    return _decode(kept, ended, schema)


def job_start_events(lines: DataFrame) -> DataFrame:
    """(app_id, pos, event) of job starts."""
    return _decode(lines, "SparkListenerJobStart", schemas.JOB_START)


def _probe(lines: DataFrame, schema, test) -> DataFrame:
    return lines.where(F.exists(F.array(_parsed(schema)), test))


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not a whole JSON object: the quarantine."""
    schema = schemas.fields(("Event", schemas.STRING))
    return _probe(lines, schema, lambda e: ~whole(F.col("value"), e["_corrupt"]))


def odd_tasks(lines: DataFrame, schema=schemas.TASK_END) -> DataFrame:
    """Lines of whole task events in which a field has another type than declared. They are
    tasks like the others, with NULL in that field."""
    ended = lines.where(F.col("value").contains("SparkListenerTaskEnd"))
    return _probe(
        ended,
        schema,
        lambda e: (e["Event"] == "SparkListenerTaskEnd")
        & e["_corrupt"].isNotNull()
        & whole(F.col("value"), e["_corrupt"]),
    )


def event_table(lines: DataFrame) -> DataFrame:
    """(kind, app_id, pos, event, value) as a table in folders by kind, from one pass over the
    text: 'task' and 'job' events, and 'broken' lines with their text. Other events are left out.

    For analyses that need several kinds of one log: compressed logs are then unpacked once.
    """
    schema = T.StructType([*schemas.TASK_END.fields, *schemas.JOB_START.fields[1:]])
    named = F.when(F.col("value").contains("SparkListenerTaskEnd"), "task").when(
        F.col("value").contains("SparkListenerJobStart"), "job"
    )
    # Of other lines only the syntax matters: their fields are skipped over.
    decoded = F.struct(
        F.when(named.isNotNull(), _parsed(schema)).alias("event"),
        F.when(named.isNull(), _parsed(schemas.fields(("Event", schemas.STRING)))).alias("other"),
    )
    read = lines.select(
        "app_id", "pos", "value", named.alias("named"), F.inline(F.array(decoded))
    )
    told = F.when(F.col("named") == "task", "SparkListenerTaskEnd").otherwise("SparkListenerJobStart")
    good = whole(F.col("value"), F.coalesce("event._corrupt", "other._corrupt"))
    kind = F.when(~good, "broken").when(F.col("event.Event") == told, F.col("named"))
    sorted_out = read.withColumn("kind", kind).where("kind is not null")
    text = F.when(F.col("kind") == "broken", F.col("value")).alias("value")
    event = F.when(F.col("kind") != "broken", F.col("event").dropFields("_corrupt")).alias("event")
    return materialize(
        sorted_out.select("kind", "app_id", "pos", event, text), "events", partition_by=("kind",)
    )


def bad_line_counts(lines: DataFrame) -> DataFrame:
    return bad_lines(lines).groupBy("app_id").agg(F.count(F.lit(1)).alias("bad_lines"))


def jobs_from_events(job_starts: DataFrame) -> DataFrame:
    """(app_id, job_id, name, submit_ms, pos): a job is named after its highest stage."""
    event = F.col("event")
    infos = event["Stage Infos"]
    top = F.array_max(event["Stage IDs"])
    named = F.filter(infos, lambda s: s["Stage ID"] == top)
    # A repeated info for the stage replaces the earlier one.
    return job_starts.select(
        "app_id",
        event["Job ID"].alias("job_id"),
        F.try_element_at(named, F.lit(-1))["Stage Name"].alias("name"),
        event["Submission Time"].alias("submit_ms"),
        "pos",
    )


def job_stages_from_events(job_starts: DataFrame) -> DataFrame:
    """(app_id, job_id, stage_id, pos): n:m, a stage may serve many jobs."""
    event = F.col("event")
    return job_starts.select(
        "app_id",
        event["Job ID"].alias("job_id"),
        F.explode(event["Stage IDs"]).alias("stage_id"),
        "pos",
    )
