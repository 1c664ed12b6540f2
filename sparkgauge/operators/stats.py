"""Distribution summaries: exact percentiles, duration-weighted percentiles, CDFs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.constants import SUMMARY_PERCENTILES, WEIGHTED_PERCENTILES
from sparkgauge.operators.ordered import distinct_ranks, pick_ranks


def percentile_name(percentile: float) -> str:
    return "p" + f"{percentile:g}".replace(".", "_")


def summary(
    df: DataFrame,
    keys: list[str],
    value: str,
    percentiles=SUMMARY_PERCENTILES,
    pieces: int | None = None,
    cut_by: str | None = None,
) -> DataFrame:
    """n, min, max and exact linearly interpolated percentiles per group.

    Ranks are found over pieces of the sorted values, so a group may be of any size.
    """
    values = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    ranked = distinct_ranks(values, keys, value, pieces=pieces, cut_by=cut_by)
    groups = ranked.pieces.select(*keys, "n_total").distinct()
    at = {p: (F.col("n_total") - 1) * F.lit(p) / F.lit(100.0) for p in percentiles}
    # The two ranks around each percentile, and the extremes.
    wanted = [F.struct(F.lit("min").alias("pick"), F.lit(1).cast("long").alias("rank"))]
    wanted.append(F.struct(F.lit("max").alias("pick"), F.col("n_total").alias("rank")))
    for p in percentiles:
        for side, rounded in (("lo", F.floor(at[p])), ("hi", F.ceil(at[p]))):
            wanted.append(
                F.struct(
                    F.lit(f"{percentile_name(p)}_{side}").alias("pick"),
                    (rounded + 1).cast("long").alias("rank"),
                )
            )
    picks = groups.select(*keys, F.explode(F.array(*wanted)).alias("w")).select(*keys, "w.*")
    found = pick_ranks(ranked, keys, picks, value)

    def picked(name: str) -> Column:
        return F.max(F.when(F.col("pick") == name, F.col("value"))).alias(name)

    names = ["min", "max"]
    for p in percentiles:
        names += [f"{percentile_name(p)}_lo", f"{percentile_name(p)}_hi"]
    wide = groups.join(found.groupBy(*keys).agg(*[picked(name) for name in names]), keys)
    columns = []
    for p in percentiles:
        name = percentile_name(p)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        columns.append((low + (high - low) * (at[p] - F.floor(at[p]))).alias(name))
    return wide.select(*keys, F.col("n_total").alias("n"), *columns, "min", "max")


#: Size of a sketch: ranks are off by about 1.3 % of the rows at 200, by 0.1 % at 4000.
SKETCH = 4000


def sketches(df: DataFrame, keys: list[str], value: str, size: int = SKETCH) -> DataFrame:
    """(keys, sketch, n, min, max): KLL quantile sketches, for `sketch_summary`.

    An opt-in alternative to `summary` without any ranking: one aggregate with map-side combine,
    a few kilobytes per group. Rows of this table can be kept, and merged over groups later.
    """
    values = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    return values.groupBy(*keys).agg(
        F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"),
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def merged_sketches(sketched: DataFrame, keys: list[str], size: int = SKETCH) -> DataFrame:
    """Sketches of coarser groups, as of all applications together, from those of finer ones."""
    return sketched.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"),
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def sketch_summary(sketched: DataFrame, keys: list[str], percentiles=SUMMARY_PERCENTILES) -> DataFrame:
    """The columns of `summary` from sketches: percentiles are values near the exact rank (not
    interpolated), n and the extremes are exact."""
    return sketched.select(
        *keys,
        "n",
        *[
            F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(percentile_name(p))
            for p in percentiles
        ],
        "min",
        "max",
    )


def summaries(
    df: DataFrame, keys: list[str], values: list[str], percentiles=(50,), pieces: int | None = None
) -> DataFrame:
    """`summary` of several columns at once, one row per (keys, metric)."""
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value"))
                    for v in values
                ]
            )
        ).alias("m"),
    ).select(*keys, "m.*")
    return summary(long, [*keys, "metric"], "value", percentiles, pieces, cut_by="metric")


def summaries_wide(
    df: DataFrame, keys: list[str], values: list[str], pieces: int | None = None
) -> DataFrame:
    """Min, median and max of several columns, one row per group: <value>_min, _med, _max."""
    long = summaries(df, keys, values, (50,), pieces)
    columns = []
    for v in values:
        for name, column in (("min", "min"), ("med", "p50"), ("max", "max")):
            columns.append(
                F.max(F.when(F.col("metric") == v, F.col(column))).alias(f"{v}_{name}")
            )
    return long.groupBy(*keys).agg(*columns)


def weighted_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str = "value",
    weight: str = "weight",
    rule: str = "reference",
    percentiles=WEIGHTED_PERCENTILES,
    pieces: int | None = None,
    cut_by: str | None = None,
) -> DataFrame:
    """Percentiles of `value` with each row weighted by `weight` (integer), and the mean.

    Rows are sorted by (value, weight); f(i) is the first row where the running share of the
    weight exceeds percentile i. `rule='standard'` reports the value of row f(i).
    `rule='reference'` reports at most one percentile per row: a row that exceeds several
    percentiles gives the lowest of them, the next row the next one, and so on; a percentile
    for which no row is left is NULL.
    """
    if rule not in ("reference", "standard"):
        raise ValueError(f"unknown rule {rule!r}")
    ranked = distinct_ranks(df, keys, value, weight, pieces=pieces, cut_by=cut_by)
    share = [p / 100 for p in percentiles]
    w = F.col(weight)
    total = F.col("weight_total").cast("double")
    before = F.coalesce("weight_before", F.lit(0))

    def over(mass: Column, p: float) -> Column:
        return F.try_divide(mass.cast("double"), total) > p

    def first_copy(p: float) -> Column:
        """Which of the row's n equal copies is the first one over p."""
        guess = F.floor(F.try_divide(p * total - before, w.cast("double")))
        near = F.sequence(F.greatest(guess - 1, F.lit(1)), F.greatest(guess + 2, F.lit(1)))
        return F.element_at(F.filter(near, lambda k: over(before + k * w, p)), 1)

    firsts = []
    for i, p in enumerate(share):
        crosses = ~over(before, p) & over(before + F.col("n") * w, p)
        firsts.append(
            F.min(F.when(crosses, F.coalesce("rank_before", F.lit(0)) + first_copy(p))).alias(f"_f{i}")
        )
    groups = (
        ranked.rows.groupBy(*keys)
        .agg(
            *firsts,
            F.max("n_total").alias("n"),
            F.sum(F.col(value) * w * F.col("n")).alias("_moment"),
            F.max("weight_total").alias("_total"),
        )
        .withColumn("mean", F.try_divide(F.col("_moment"), F.col("_total")))
    )
    wanted = []
    for i, p in enumerate(percentiles):
        first = [F.coalesce(f"_f{j}", F.col("n") + 1) for j in range(i + 1)]
        if rule == "standard":
            rank = first[i]
        else:
            shifts = [first[j] - j for j in range(i + 1)]
            rank = (F.greatest(*shifts) if len(shifts) > 1 else shifts[0]) + i
        wanted.append(
            F.struct(
                F.lit(percentile_name(p)).alias("pick"), rank.cast("long").alias("rank")
            )
        )
    picks = groups.select(*keys, F.explode(F.array(*wanted)).alias("w")).select(*keys, "w.*")
    found = (
        pick_ranks(ranked, keys, picks, value)
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("pick") == percentile_name(p), F.col("value"))).alias(
                    percentile_name(p)
                )
                for p in percentiles
            ]
        )
    )
    return groups.join(found, keys, "left").select(
        *keys, "n", *[percentile_name(p) for p in percentiles], "mean"
    )


CHUNK = 10000


def cdf(df: DataFrame, keys: list[str], value: str, pieces: int | None = None) -> DataFrame:
    """Every row of the sorted values with its 0-based index inside the group.

    Equal values are ranked once and given back as index ranges, in chunks that are dealt out
    again, so neither a big group nor one very frequent value sits in a single task.
    """
    ranked = distinct_ranks(df, keys, value, pieces=pieces).rows
    start = F.coalesce("rank_before", F.lit(0)).cast("long")
    end = start + F.col("n") - 1
    chunks = ranked.select(
        *keys, value, end.alias("_end"), F.explode(F.sequence(start, end, F.lit(CHUNK).cast("long"))).alias("_from")
    )
    return (
        chunks.repartition(*[F.col(k) for k in keys], F.col("_from"))
        .select(
            *keys,
            value,
            F.explode(
                F.sequence("_from", F.least(F.col("_from") + CHUNK - 1, F.col("_end")))
            ).alias("index"),
        )
        .select(*keys, "index", value)
    )


def error_bars(summarised: DataFrame) -> DataFrame:
    """Median with the distances to the extremes."""
    return summarised.withColumn("err_low", F.col("p50") - F.col("min")).withColumn(
        "err_high", F.col("max") - F.col("p50")
    )
