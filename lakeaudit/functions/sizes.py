"""Human-readable sizes and durations as native column expressions.

Texts that do not parse, and products beyond BIGINT, give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit suffixes and their factors.
SIZE_UNITS = {"": 1, "B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3}
TIME_UNITS_MS = {"": 1000, "MS": 1, "S": 1000, "M": 60_000, "H": 3_600_000}
TIME_LABELS = ("小时", "分钟", "秒", "毫秒")


def _parse(col: Column, units: dict[str, int]) -> Column:
    # Blanks and control characters around the text are dropped, as Java's trim does.
    names = "|".join(u for u in units if u)
    pattern = rf"^[\x00-\x20]*([+-]?[0-9]+)({names})?[\x00-\x20]*\z"
    text = F.upper(col)
    number = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.lit(None).cast("bigint")
    for name, value in units.items():
        factor = F.when(unit == name, F.lit(value).cast("bigint")).otherwise(factor)
    return F.try_multiply(number, factor)


def parse_size(col: Column) -> Column:
    """``10KB`` → 10240; no suffix means bytes."""
    return _parse(col, SIZE_UNITS)


def parse_time(col: Column) -> Column:
    """``2m`` → 120000 ms; no suffix means seconds; ``ms`` is accepted."""
    return _parse(col, TIME_UNITS_MS)


def _format(col: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = F.concat(col.cast("string"), F.lit(f" {last}"))
    for factor, label in reversed(steps):
        scaled = F.format_string(f"%.2f {label}", col.cast("double") / F.lit(float(factor)))
        out = F.when(col >= factor, scaled).otherwise(out)
    return F.when(col.isNotNull(), out)


def format_size(col: Column) -> Column:
    return _format(col, [(1024**3, "GB"), (1024**2, "MB"), (1024, "KB")], "B")


def format_time(col: Column, labels: tuple[str, str, str, str] = TIME_LABELS) -> Column:
    hours, minutes, seconds, millis = labels
    return _format(col, [(3_600_000, hours), (60_000, minutes), (1000, seconds)], millis)


def split_ints(col: Column) -> Column:
    """Comma list to an int array; an element that is no integer is NULL."""
    return F.transform(F.split(col, ","), lambda x: F.trim(x).try_cast("int"))
