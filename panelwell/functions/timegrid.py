"""Time expressions: an epoch-anchored grid in microseconds, and clock text.

Naive timestamps are handled as microseconds since the Unix epoch. ``unix_micros`` takes
zoned timestamps only, so values pass through ``TIMESTAMP`` with the session zone at UTC.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def hours_to_micros(hours: float) -> int:
    return int(round(hours * MICROS_PER_HOUR))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def grid_index(ts: Column, width_micros: int) -> Column:
    """Number of the grid cell holding ``ts``, counted from the epoch (floors below it too)."""
    return floor_div(micros(ts), width_micros)


def floor_div(value: Column, width: int) -> Column:
    width_col = F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, width_col), width_col)


def floor_time(ts: Column, hours: float) -> Column:
    """``ts`` rounded down to a multiple of ``hours`` since the epoch."""
    width = F.lit(hours_to_micros(hours)).cast("bigint")
    us = micros(ts)
    return from_micros(us - F.pmod(us, width))


def shift_hours(ts: Column, hours: float) -> Column:
    return from_micros(micros(ts) + F.lit(hours_to_micros(hours)).cast("bigint"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)).cast("double") / F.lit(float(MICROS_PER_HOUR))


def clock_to_hours(text: Column) -> Column:
    """``10:30 PM`` → 22.5; a plain number passes through; anything else is null."""
    cleaned = F.upper(F.trim(text))
    # an explicit guard keeps the parser to one- or two-digit hours and a meridiem
    is_clock = cleaned.rlike(r"^\d{1,2}:\d{1,2} [AP]M$")
    parsed = F.try_to_timestamp(F.when(is_clock, cleaned), F.lit("h:m a"))
    clock = F.hour(parsed) + F.minute(parsed) / F.lit(60.0)
    return F.coalesce(clock, cleaned.try_cast("double"))


def sleep_category(hours: Column) -> Column:
    """Under five hours 0, up to ten 1, more 2; unknown stays null."""
    return F.when(hours < 5, F.lit(0)).when(hours <= 10, F.lit(1)).when(hours > 10, F.lit(2)).cast("int")


def cyclic_hour(ts: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * F.hour(ts) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def cyclic_weekday(ts: Column) -> tuple[Column, Column]:
    """Monday is 0."""
    angle = F.lit(2 * math.pi) * F.weekday(ts) / F.lit(7.0)
    return F.sin(angle), F.cos(angle)
