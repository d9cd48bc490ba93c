"""Numbers that behave as floating-point arrays do: no null and no error where there is a NaN or an infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divided(a: Column, b: Column) -> Column:
    """a / b, with signed infinities and NaN over zero."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, INF).when(a < 0, -INF).when(a.isNotNull() & b.isNotNull(), NAN)


def finite(a: Column) -> Column:
    """NaN as 0, infinities as the largest doubles."""
    most = 1.7976931348623157e308
    return F.when(F.isnan(a), 0.0).when(a == INF, most).when(a == -INF, -most).otherwise(a)


def whole(a: Column) -> Column:
    """Truncated toward zero, negatives modulo 2^32, as unsigned 32-bit integers are."""
    return F.pmod(a.cast("bigint"), F.lit(4294967296))


def rescaled(a: Column, low: Column, high: Column) -> Column:
    """0 to 255: the absolute least value is added whatever its sign, then all is divided by the largest sum and truncated."""
    return F.floor(divided(a + F.abs(low), high + F.abs(low)) * 255).cast("int")
