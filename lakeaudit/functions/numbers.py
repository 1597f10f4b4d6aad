"""Whole-number arithmetic that stays in BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient, towards zero; no detour through DOUBLE."""
    divisor = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, divisor)
