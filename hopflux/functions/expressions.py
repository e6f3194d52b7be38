from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopflux.constants import INF


def clamp(value: Column, low: float, high: float) -> Column:
    """Bring a double into [low, high]; NaN and null pass through (``greatest`` and ``least`` would rank NaN largest)."""
    return F.when(F.isnan(value) | value.isNull(), value).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def missing(value: Column, is_float: bool) -> Column:
    """Null, or NaN for floating columns: what data frames call missing."""
    return value.isNull() | F.isnan(value) if is_float else value.isNull()


def or_infinity(value: Column, return_inf: bool) -> Column:
    """An unreached vertex's distance: infinity, or the largest double."""
    return F.coalesce(value, F.lit(float("inf") if return_inf else INF))
