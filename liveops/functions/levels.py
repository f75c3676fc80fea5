"""Levels, clocks and integer powers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unity level and the largest level.
NORM, LEVEL_MAX = 0x10000, 0x7FFFFFFF
TICKS_PER_SECOND = {"90khz": 90_000, "27mhz": 27_000_000, "ms": 1000}


def clamp(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(LEVEL_MAX)), F.lit(0)).cast("bigint")


def from_linear(value: Column) -> Column:
    """Cube-root mapping, so that a linear factor and its level convert back exactly."""
    return F.when(value <= 0, F.lit(0).cast("bigint")).otherwise(
        clamp(F.round(F.cbrt(value) * NORM))
    )


def to_linear(level: Column) -> Column:
    share = level / F.lit(float(NORM))
    return F.when(level <= 0, 0.0).otherwise(share * share * share)


def multiply(a: Column, b: Column) -> Column:
    return clamp(F.floor((a * b + NORM // 2) / NORM))


def divide(a: Column, b: Column) -> Column:
    half = F.floor(b / 2)
    return F.when(b <= 0, F.lit(0).cast("bigint")).otherwise(F.floor((a * NORM + half) / b))


def power(base: Column, exponent: Column) -> Column:
    """Integer power; exact up to 2**53."""
    return F.round(F.pow(base.cast("double"), exponent)).cast("bigint")


def seconds(ticks: Column, clock: str) -> Column:
    return ticks / F.lit(float(TICKS_PER_SECOND[clock]))


def ticks(value: Column, clock: str) -> Column:
    return F.round(value * TICKS_PER_SECOND[clock]).cast("bigint")


def local_time(epoch: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text in the session time zone."""
    return F.date_format(F.timestamp_seconds(epoch), pattern)


def log_time(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds of a log line's time in the session time zone; null when malformed."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(pattern)))
