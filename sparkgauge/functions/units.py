"""Quantities as people read them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
BIT_UNITS = ("b", "Kb", "Mb", "Gb", "Tb")


def scaled(size: Column, units: tuple[str, ...] = BYTE_UNITS) -> Column:
    """struct(value, unit): a unit is used from twice its size on, by absolute value."""
    size = size.cast("double")
    chosen = None
    for power in range(len(units) - 1, 0, -1):
        factor = float(1 << (10 * power))
        part = F.struct((size / factor).alias("value"), F.lit(units[power]).alias("unit"))
        at_least = F.abs(size) >= 2 * factor
        chosen = F.when(at_least, part) if chosen is None else chosen.when(at_least, part)
    return chosen.otherwise(F.struct(size.alias("value"), F.lit(units[0]).alias("unit")))


def bytes_text(size: Column) -> Column:
    quantity = scaled(size, BYTE_UNITS)
    return F.format_string("%.2f %s", quantity["value"], quantity["unit"])


def bits_text(size: Column) -> Column:
    quantity = scaled(size, BIT_UNITS)
    return F.format_string("%.2f %s", quantity["value"], quantity["unit"])


def ms_to_s(millis: Column) -> Column:
    return millis / F.lit(1000.0)


def last_path_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
