"""Order-dependent operators that never put a whole group into one task.

A running sum, a rank or an exact percentile over a group is usually a window partitioned by
the group, so one group is one task. Here the rows are first split into consecutive *pieces*:
ranges of the leading order column over all rows, so a piece holds about 1/pieces of the data
no matter how the rows spread over groups. The rows are written once with their piece number.
Each piece is scanned on its own; what the earlier pieces contribute comes from one small row
per piece.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.session import materialize

PIECE = "_piece"


class Running(NamedTuple):
    """A running value over the rows before this one (and this one, if `inclusive`).

    kind: 'sum', 'max', 'min', 'first' or 'last' (of non-null values), or 'total' (the sum
    over the whole group).
    """

    kind: str
    column: Column
    inclusive: bool = False


class Scan(NamedTuple):
    rows: DataFrame
    pieces: DataFrame


def add_piece(
    df: DataFrame, cut_on: str, pieces: int | None = None, cut_by: str | None = None
) -> DataFrame:
    """`df` as a table with the piece number of each row.

    Pieces are ranges of `cut_on`, as many as the session's shuffle partitions if `pieces` is
    not given; equal values share a piece. `cut_by` names a column (a measure name) whose values
    get ranges of their own. Where the limits fall affects balance only, never results, but the
    number must not change between reads, so the table is written.
    """
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [cut_on] if cut_by is None else [cut_by, cut_on]
    return materialize(
        df.repartitionByRange(pieces, *by).withColumn(PIECE, F.spark_partition_id()), "pieces"
    )


_PARTIAL = {
    "sum": lambda r, order: F.sum(r.column),
    "total": lambda r, order: F.sum(r.column),
    "max": lambda r, order: F.max(r.column),
    "min": lambda r, order: F.min(r.column),
    "first": lambda r, order: F.min_by(r.column, F.when(r.column.isNotNull(), order)),
    "last": lambda r, order: F.max_by(r.column, F.when(r.column.isNotNull(), order)),
}
_COMBINE = {
    "sum": lambda earlier, here: F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "max": lambda earlier, here: F.greatest(earlier, here),
    "min": lambda earlier, here: F.least(earlier, here),
    "first": lambda earlier, here: F.coalesce(earlier, here),
    "last": lambda earlier, here: F.coalesce(here, earlier),
}


def _over(kind: str, column: Column, window) -> Column:
    if kind == "sum":
        return F.sum(column).over(window)
    if kind == "max":
        return F.max(column).over(window)
    if kind == "min":
        return F.min(column).over(window)
    if kind == "first":
        return F.first(column, ignorenulls=True).over(window)
    return F.last(column, ignorenulls=True).over(window)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    running: dict[str, Running],
    pieces: int | None = None,
    cut_on: str | None = None,
    cut_by: str | None = None,
    staged: bool = True,
) -> Scan:
    """Running values per group in `order` (ascending), scanned piece by piece.

    `cut_on` must grow with `order`; by default it is the leading order column. A frame that
    already has a piece column (for example the log split a line came from) keeps it; it is read
    twice and `staged` as a table first, unless it is one already.
    """
    if PIECE not in df.columns:
        df = add_piece(df, cut_on or order[0], pieces, cut_by)
    elif staged:
        df = materialize(df, "ordered")
    piece_keys = [*keys, PIECE]
    order_struct = F.struct(*order)
    sums = df.groupBy(*piece_keys).agg(
        *[_PARTIAL[r.kind](r, order_struct).alias(f"_part_{name}") for name, r in running.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = sums.select(
        *piece_keys,
        *[
            (
                F.sum(f"_part_{name}").over(whole)
                if r.kind == "total"
                else _over(r.kind, F.col(f"_part_{name}"), earlier)
            ).alias(f"_carry_{name}")
            for name, r in running.items()
        ],
    )
    in_piece = Window.partitionBy(*piece_keys).orderBy(*order)
    local = df.select(
        "*",
        *[
            _over(
                r.kind,
                r.column,
                in_piece.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1),
            ).alias(f"_here_{name}")
            for name, r in running.items()
            if r.kind != "total"
        ],
    )
    joined = local.join(carried, piece_keys)
    rows = joined.select(
        *df.columns,
        *[
            (
                F.col(f"_carry_{name}")
                if r.kind == "total"
                else _COMBINE[r.kind](F.col(f"_carry_{name}"), F.col(f"_here_{name}"))
            ).alias(name)
            for name, r in running.items()
        ],
    )
    starts = carried.select(
        *piece_keys, *[F.col(f"_carry_{name}").alias(name) for name in running]
    )
    return Scan(rows, starts)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", **options):
    """1-based row number inside each group."""
    counted = ordered_scan(
        df, keys, order, {name: Running("sum", F.lit(1).cast("long"), inclusive=True)}, **options
    )
    return counted.rows.drop(PIECE)


def distinct_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    weight: str | None = None,
    pieces: int | None = None,
    cut_by: str | None = None,
) -> Scan:
    """Equal (value, weight) rows folded to one with count `n`, ranked inside each group.

    Adds rank_before and n_total (rows), and with a weight weight_before and weight_total.
    """
    columns = [value] if weight is None else [value, weight]
    folded = df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("n"))
    running = {
        "rank_before": Running("sum", F.col("n")),
        "n_total": Running("total", F.col("n")),
    }
    if weight is not None:
        mass = F.col(weight) * F.col("n")
        running["weight_before"] = Running("sum", mass)
        running["weight_total"] = Running("total", mass)
    return ordered_scan(folded, keys, columns, running, pieces, cut_by=cut_by)


def pick_ranks(ranked: Scan, keys: list[str], picks: DataFrame, value: str) -> DataFrame:
    """Values at wanted 1-based ranks. `picks` is (keys, pick, rank), few rows per group.

    The piece that holds a rank is found in the piece table, so the rows are joined on
    (keys, piece) and no group gathers in one task.
    """
    after = (
        Window.partitionBy(*keys).orderBy(PIECE)
    )
    spans = ranked.pieces.select(
        *keys,
        PIECE,
        F.coalesce("rank_before", F.lit(0)).alias("_from"),
        F.lead(F.coalesce("rank_before", F.lit(0)), 1).over(after).alias("_next"),
        "n_total",
    )
    held = (
        picks.join(spans, keys)
        .where(
            (F.col("rank") > F.col("_from"))
            & (F.col("rank") <= F.coalesce("_next", "n_total"))
        )
        .select(*keys, PIECE, "pick", "rank")
    )
    found = ranked.rows.join(held, [*keys, PIECE]).where(
        (F.col("rank") > F.col("rank_before"))
        & (F.col("rank") <= F.col("rank_before") + F.col("n"))
    )
    return found.select(*keys, "pick", F.col(value).alias("value"))
