"""Joins with a smaller side whose size is not known to be bounded."""

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def salted_join(
    rows: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    condition: Column | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Equi-join of many rows with a small table, safe when one key holds much of `rows`.

    The small side is repeated per salt and the rows of a key spread over the salts by a hash
    of `spread_by`. No broadcast hint: the planner broadcasts the small side when its own size
    estimate, or the measured size at run time, is under its threshold, else it shuffles. By
    default there are as many salts as the square root of the session's shuffle partitions. The
    salt also lets AQE split a skewed partition further, since the aggregate that follows does
    not group by the salt and re-shuffles its partial results anyway.
    """
    if salts is None:
        salts = max(2, isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    left = rows.withColumn(SALT, spread)
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if condition is None:
        return left.join(right, [*on, SALT], how).drop(SALT)
    left, right = left.alias("l"), right.alias("r")
    equal = F.lit(True)
    for name in [*on, SALT]:
        equal = equal & (F.col(f"l.{name}") == F.col(f"r.{name}"))
    joined = left.join(right, equal & condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop(SALT)
    extra = [F.col(f"r.{c}") for c in small.columns if c not in rows.columns]
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], *extra)
