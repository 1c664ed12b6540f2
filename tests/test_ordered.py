"""Piecewise scans against direct loops, for any number of pieces and partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import stats
from sparkgauge.operators.ordered import Running, ordered_scan, row_numbers

SHARES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
NAMES = ["p5", "p25", "p50", "p75", "p95", "p99"]


def one_percentile_per_row(pairs):
    """Walk the sorted rows; a row over the open percentile closes it and only it."""
    pairs = sorted(pairs)
    total, seen, out = sum(w for _, w in pairs), 0, []
    for value, weight in pairs:
        seen += weight
        if len(out) < len(SHARES) and seen / total > SHARES[len(out)]:
            out.append(value)
    return out + [None] * (len(SHARES) - len(out))


def all_percentiles(pairs):
    pairs = sorted(pairs)
    total, out = sum(w for _, w in pairs), []
    for share in SHARES:
        seen = 0
        for value, weight in pairs:
            seen += weight
            if seen / total > share:
                out.append(value)
                break
    return out


def groups(seed, n_groups=40):
    rng = random.Random(seed)
    out = {}
    for g in range(n_groups):
        size = rng.choice([1, 2, 3, 6, 20, 60])
        values = rng.choice([3, 10, 1000])
        out[g] = [(float(rng.randrange(values)), rng.choice([0, 1, 5, 100, 5000])) for _ in range(size)]
        if not sum(w for _, w in out[g]):
            out[g].append((1.0, 7))
    out["hot"] = [(float(rng.randrange(50)) / 7, rng.randrange(1, 9)) for _ in range(1500)]
    return {str(k): v for k, v in out.items()}


@pytest.mark.parametrize("pieces", [1, 5, 64])
@pytest.mark.parametrize("rule,expected", [("reference", one_percentile_per_row), ("standard", all_percentiles)])
def test_weighted_percentiles(spark, pieces, rule, expected):
    data = groups(pieces)
    rows = [(g, v, w) for g, pairs in data.items() for v, w in pairs]
    df = spark.createDataFrame(rows, "g string, value double, weight long").repartition(5)
    result = stats.weighted_percentiles(df, ["g"], rule=rule, pieces=pieces).collect()
    assert len(result) == len(data)
    for row in result:
        pairs = data[row["g"]]
        assert [row[n] for n in NAMES] == expected(pairs), (row["g"], sorted(pairs))
        assert row["n"] == len(pairs)
        assert row["mean"] == pytest.approx(np.average([v for v, _ in pairs], weights=[w for _, w in pairs]))


@pytest.mark.parametrize("pieces", [1, 9])
def test_summary_equals_numpy(spark, pieces):
    data = groups(7)
    rows = [(g, v) for g, pairs in data.items() for v, _ in pairs]
    df = spark.createDataFrame(rows, "g string, value double")
    for row in stats.summary(df, ["g"], "value", pieces=pieces).collect():
        values = [v for v, _ in data[row["g"]]]
        wanted = np.percentile(values, [5, 25, 50, 75, 95])
        assert [row[n] for n in NAMES[:5]] == pytest.approx(list(wanted))
        assert (row["min"], row["max"], row["n"]) == (min(values), max(values), len(values))


def test_weight_zero_everywhere_gives_null(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0)], "g string, value double, weight long")
    row = stats.weighted_percentiles(df, ["g"]).collect()[0]
    assert row["mean"] is None and row["p50"] is None


@pytest.mark.parametrize("pieces", [1, 4, 50])
def test_scans_equal_loops(spark, pieces):
    rng = random.Random(pieces)
    rows = [(rng.choice("aaab"), t, rng.choice([None, rng.randrange(100)])) for t in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(7)
    running = {
        "s": Running("sum", F.col("v"), inclusive=True),
        "top": Running("max", F.col("v")),
        "low": Running("min", F.col("v"), inclusive=True),
        "prev": Running("last", F.col("v")),
        "first": Running("first", F.col("v"), inclusive=True),
        "all": Running("total", F.col("v")),
    }
    got = {r["t"]: r for r in ordered_scan(df, ["k"], ["t"], running, pieces).rows.collect()}
    for key in "ab":
        before, total = [], sum(v or 0 for k, _, v in rows if k == key)
        for k, t, v in rows:
            if k != key:
                continue
            row, known = got[t], [x for x in before if x is not None]
            upto = known + ([v] if v is not None else [])
            assert row["s"] == sum(upto) and row["all"] == total
            assert row["top"] == (max(known) if known else None)
            assert row["low"] == (min(upto) if upto else None)
            assert row["prev"] == (known[-1] if known else None)
            assert row["first"] == (upto[0] if upto else None)
            before.append(v)


def test_row_numbers_are_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("t"))
    ranks = row_numbers(df, ["k"], ["t"], pieces=10)
    per_key = ranks.groupBy("k").agg(F.count("*").alias("n"), F.min("rank"), F.max("rank"), F.count_distinct("rank")).collect()
    assert all(r[1] == r[4] and r[2] == 1 and r[3] == r[1] for r in per_key)


def test_cdf_gives_every_copy_back(spark):
    # One value holds most rows of the hot group, more than a chunk.
    df = spark.range(0, 25000).select(
        F.when(F.col("id") % 100 == 0, "small").otherwise("hot").alias("g"),
        F.when(F.col("id") % 10 == 1, F.col("id")).otherwise(0).cast("double").alias("v"),
    )
    out = stats.cdf(df, ["g"], "v")
    assert out.count() == 25000
    got = sorted((r["index"], r["v"]) for r in out.where("g = 'hot'").collect())
    values = sorted(r["v"] for r in df.where("g = 'hot'").collect())
    assert got == list(enumerate(values))


def test_sketches_merge_over_groups(spark):
    """Percentiles from sketches lie within a few thousandths of the exact rank, merged ones too."""
    draw = np.random.default_rng(23)
    rows = [(f"app-{i % 3}", float(v)) for i, v in enumerate(draw.lognormal(3, 2, 60_000))]
    frame = spark.createDataFrame(rows, "app_id string, v double").unionByName(
        spark.createDataFrame([("app-0", None)], "app_id string, v double")
    )
    by_app = stats.sketches(frame, ["app_id"], "v")
    together = stats.merged_sketches(by_app.withColumn("k", F.lit("all")), ["k"])
    groups = {r["app_id"]: r for r in stats.sketch_summary(by_app, ["app_id"]).collect()}
    groups["all"] = stats.sketch_summary(together, ["k"]).collect()[0]
    for name, got in groups.items():
        values = np.sort([v for app, v in rows if name in ("all", app)])
        assert (got["n"], got["min"], got["max"]) == (len(values), values[0], values[-1])
        for p in (5, 25, 50, 75, 95):
            rank = np.searchsorted(values, got[f"p{p}"], "right") / len(values)
            assert abs(rank - p / 100) < 0.004
