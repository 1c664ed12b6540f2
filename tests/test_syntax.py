"""The test of whole lines costs a second parse only where it is needed; tables in folders are not sorted."""

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from sparkgauge import session
from sparkgauge.session import WRITERS_CONF, materialize
from sparkgauge.sources import event_log

LINES = {
    '{"Event":"x","a":1}': True,
    '{"Event":"x","a":1} \t\r': True,
    '{"a":NaN,"a":[{"b":1},{"c":2}]}': True,
    "{}": True,
    '{"a":1}{"b":2}': False,
    '{"a":1},{"b":2}': False,
    '{"a":"}{"}': True,
    '{"a":1}{}': False,
    '{"a":1} x': False,
    '{"a":1': False,
    'WARN {"a":1}': False,
    '[{"a":1}]': False,
    "null": False,
    " ": False,
    "": False,
    None: False,
}


def test_whole_lines(spark):
    lines = spark.createDataFrame([(k, None) for k in LINES], "value string, corrupt string")
    marked = lines.withColumn("corrupt", F.col("value"))
    alone = lines.select("value", event_log.whole(F.col("value")).alias("whole"))
    told = marked.select("value", event_log.whole(F.col("value"), F.col("corrupt")).alias("whole"))
    for frame in (alone, told):
        assert {r.value: r.whole for r in frame.collect()} == LINES


def test_a_sound_line_is_not_parsed_again(spark):
    """What is named twice, or on the right of an AND or OR that is named twice, is worked out for all lines."""
    lines = spark.createDataFrame([("{}", None)], "value string, corrupt string")
    plan = lines.select(event_log.whole(F.col("value"), F.col("corrupt")).alias("whole"))
    text = plan._jdf.queryExecution().analyzed().toString()
    assert text.count("from_json(") == 1
    assert "OR" not in text and "CASE WHEN (isnull(corrupt" in text


def test_few_folders_are_written_without_a_sort(spark, monkeypatch):
    during = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(
        DataFrameWriter, "parquet", lambda w, path: during.append(spark.conf.get(WRITERS_CONF)) or write(w, path)
    )
    before = spark.conf.get(WRITERS_CONF)
    table = materialize(spark.range(100).selectExpr("id", "id % 20 AS kind"), "kinds", partition_by=("kind",))
    assert during == [session.WRITERS] and spark.conf.get(WRITERS_CONF) == before
    assert sorted(tuple(r) for r in table.select("id", "kind").collect()) == [(i, i % 20) for i in range(100)]
