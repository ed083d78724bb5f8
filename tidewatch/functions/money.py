"""Exact money: minor units, half-even rounding, base-currency conversion, expected loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minor_units(amount: Column, units: Column) -> Column:
    """Whole minor units of an amount; NULL when the amount has more decimals than its currency."""
    scaled = amount * F.pow(F.lit(10), units).cast("decimal(10,0)")
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def to_base(amount: Column, rate: Column) -> Column:
    """Base-currency value, half-even to four places, never below the smallest storable amount."""
    value = F.bround(amount * rate, 4).cast("decimal(18,4)")
    smallest = F.lit("0.0001").cast("decimal(18,4)")
    return F.when(value < smallest, smallest).otherwise(value)  # a missing rate stays missing


def expected_loss(probability: Column, amount: Column) -> Column:
    return F.bround(probability.cast("decimal(9,8)") * amount, 4).cast("decimal(18,4)")
