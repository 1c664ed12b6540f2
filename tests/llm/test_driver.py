"""What reaches the driver is bounded, whatever the number of keys."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from sparkgauge.llm import collocations, line_dedup, shared


def test_lookups_of_lines_broadcast_a_bit_map_only(spark, monkeypatch):
    sent = []
    broadcast = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    lines = spark.range(9000).select(
        F.when(F.col("id") > 5, F.col("id")).alias("id"), F.lit(1).alias("h2"), F.col("id").cast("string").alias("norm")
    )
    lines = lines.unionByName(spark.range(7, 9).selectExpr("id", "0 AS h2", "concat('first ', id) AS norm"))
    ids = spark.range(3, 5000).select("id").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS id"))
    found = {r.id: r.norm for r in line_dedup._texts(lines, ids).collect()}
    assert found == {i: str(i) for i in range(6, 5000)} | {7: "first 7", 8: "first 8"}
    features = spark.range(4000).selectExpr("id", "id % 2000 AS sim", "array(id, id + 100000) AS anchors")
    fuzzy = spark.range(4000).selectExpr("id", "10 AS len", "5 AS n")
    members = line_dedup._members(features, fuzzy, 3)
    assert members.select("id").distinct().count() == 4000
    assert members.groupBy("bucket").count().where("count < 2").count() == 0
    assert sent and max(sent) <= shared.CELLS // shared.CELLS_A_ROW


def test_bit_maps_reach_the_driver_in_pieces(spark, monkeypatch):
    came = []
    to_arrow = DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: came.append(to_arrow(df)) or came[-1])
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    bits = collocations.bit_map(keys)
    place = np.array([r.key for r in keys.collect()]).view(np.uint64) >> np.uint64(64 - collocations.MAP_BITS)
    assert np.array_equal(np.flatnonzero(np.unpackbits(bits, bitorder="little")), np.unique(place))
    assert sum(t.num_rows for t in came) <= 1 << collocations.MAP_BITS - collocations.PIECE_BITS
    assert not collocations.bit_map(keys.where("false")).any()
