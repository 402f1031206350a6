"""Column helpers: null-safe division, calendar angles and rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0, null or not finite."""
    return F.when((b != 0) & ~F.isnan(b) & (F.abs(b) != float("inf")), a.cast("double") / b)


def n0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def hour_angle(ts: Column) -> Column:
    return (F.hour(ts) + F.minute(ts) / 60.0) * (2 * math.pi / 24.0)


def two_decimals(x: Column) -> Column:
    """Rounds half to even on the scaled value, as array libraries do."""
    return F.rint(x * 100.0) / 100.0


def hour_bucket(ts: Column) -> Column:
    """Bands of the day: before 5, 12, 18, 22, and later."""
    h = F.hour(ts)
    return F.when(h < 5, 0).when(h < 12, 1).when(h < 18, 2).when(h < 22, 3).otherwise(4)
