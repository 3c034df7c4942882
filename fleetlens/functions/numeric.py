"""Rounding, ratio and unit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles at or above 2^53 have no fractional part; Spark's ceil() would push
# them through a 64-bit integer and saturate.
_EXACT_INTEGER = float(2**53)


def ceil_places(value: Column, places: int) -> Column:
    """Ceiling to a number of decimal places (1.1234 -> 1.13 for two places)."""
    scale = float(10**places)
    scaled = value.cast("double") * F.lit(scale)
    up = F.when(F.abs(scaled) >= _EXACT_INTEGER, scaled).otherwise(F.ceil(scaled).cast("double"))
    return up / F.lit(scale)


def round_up2(value: Column) -> Column:
    return ceil_places(value, 2)


def round_up4(value: Column) -> Column:
    return ceil_places(value, 4)


def ratio4(numerator: Column, denominator: Column) -> Column:
    """``n / d`` rounded up to four places, 0 when the denominator is 0."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d == 0.0, F.lit(0.0)).otherwise(round_up4(n / d))


def hit_ratio(hit: Column, read: Column) -> Column:
    """``hit / (hit + read)`` rounded up to four places, 0 without any access."""
    return ratio4(hit.cast("double"), hit.cast("double") + read.cast("double"))


def interval_ms(interval: Column) -> Column:
    """Whole milliseconds of the microsecond part of a (months, days, micros) struct.

    Months and days are ignored; a missing interval stays NULL.  The division
    truncates toward zero.
    """
    micros = interval["micros"].cast("bigint")
    return ((micros - micros % F.lit(1000)) / F.lit(1000)).cast("double")


def lsn_position(lsn: Column) -> Column:
    """Byte position of a ``hi/lo`` hexadecimal log sequence number."""
    parts = F.split(lsn, "/")
    hi = F.conv(F.get(parts, F.lit(0)), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.get(parts, F.lit(1)), 16, 10).cast("decimal(20,0)")
    return hi * F.lit(4294967296).cast("decimal(10,0)") + lo


def lsn_diff(left: Column, right: Column) -> Column:
    """Byte distance ``left - right`` of two log sequence numbers, as double."""
    return (lsn_position(left) - lsn_position(right)).cast("double")
