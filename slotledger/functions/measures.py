"""Unit conversions and arithmetic shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotledger import fixed_values as fv


def gib(size: Column) -> Column:
    return size / F.lit(float(fv.BYTES_PER_GIB))


def slot_hours(slot_ms: Column) -> Column:
    return slot_ms / F.lit(float(fv.MS_PER_HOUR))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; null where ``whole`` is zero or either is null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def to_whole(value: Column) -> Column:
    """Nearest whole number, halves away from zero (a plain cast truncates)."""
    return F.round(value).cast("bigint")


def decimal_text(value: Column, places: int = 2) -> Column:
    """A number rounded to ``places`` without trailing zeros but one: 12.50 -> 12.5, 3 -> 3.0."""
    fixed = value.cast(f"decimal(38,{places})").cast("string")
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")
