"""Collected text lines: (file, line_no, line), line_no from 1 per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def drop_comments(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("line").startswith("#"))


def grep_context(lines: DataFrame, pattern: str, after: int = 2, ignore_case: bool = True) -> DataFrame:
    """Lines that match, and the ``after`` lines behind each.

    The numbers of the lines wanted are joined back to the text without a hint:
    Spark broadcasts them while they are few, and beyond that may cut the text by
    a bloom filter of them before it is shuffled. No file or block is windowed.
    """
    marked = lines.withColumn("is_match", F.col("line").rlike(("(?i)" if ignore_case else "") + pattern))
    reach = F.sequence(F.col("line_no"), F.col("line_no") + after)
    wanted = marked.where("is_match").select("file", F.explode(reach).alias("line_no")).distinct()
    return marked.join(wanted, ["file", "line_no"], "left_semi").select("file", "line_no", "line", "is_match")


def report_extract(lines: DataFrame, head: str) -> DataFrame:
    """(file, observed): the first integer of the first line that starts with ``head``.

    A report without such a line gives NULL.
    """
    wanted = F.col("line").startswith(head)
    number = F.regexp_extract("line", "([0-9]+)", 1).try_cast("bigint")
    return lines.groupBy("file").agg(
        F.min_by(F.when(wanted, number), F.when(wanted, F.col("line_no"))).alias("observed")
    )


def health_gate(observed: DataFrame, required: int) -> DataFrame:
    """Observed against required; a report without a number fails."""
    ok: Column = F.coalesce(F.col("observed") == required, F.lit(False))
    return observed.withColumn("required", F.lit(required).cast("bigint")).withColumn("ok", ok)


def require_healthy(gate: DataFrame) -> None:
    """Raise when any row of :func:`health_gate` failed."""
    bad = gate.where(~F.col("ok")).take(1)
    if bad:
        raise RuntimeError(f"{bad[0]['file']}: expected {bad[0]['required']}, got {bad[0]['observed']}")
