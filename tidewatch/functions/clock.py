"""Local time from a fixed UTC offset, and questions asked of a local date."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def local_time(t: Column, offset_hours: Column) -> Column:
    """Local wall clock of a microsecond instant, as a timestamp in the UTC session zone."""
    return F.timestamp_micros(t + offset_hours.cast("long") * F.lit(HOUR))


def hour_sin(local: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.hour(local) / F.lit(24.0))


def hour_cos(local: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.hour(local) / F.lit(24.0))


def is_night(local: Column) -> Column:
    return F.hour(local) < 5


def is_month_end(local: Column) -> Column:
    """The first two or last three local days of a month."""
    return (F.dayofmonth(local) <= 2) | (
        F.dayofmonth(local) > F.dayofmonth(F.last_day(local)) - 3
    )
