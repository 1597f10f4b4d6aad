"""Series of runs before and after a change, and sizes in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions import sizes


def ab_compare(runs: DataFrame) -> DataFrame:
    """Mean before and after per suite and level, their difference and ratio."""

    def mean(phase: str) -> Column:
        value = F.when(F.col("phase") == phase, F.col("value"))
        return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))

    return (
        runs.groupBy("suite", "level")
        .agg(mean("before").alias("before"), mean("after").alias("after"))
        .withColumn("delta", F.col("after") - F.col("before"))
        .withColumn("ratio", F.try_divide("after", "before"))
    )


def human_size_rollup(df: DataFrame, group: str, size: str, time: str) -> DataFrame:
    """Sizes and durations parsed, summed per group and written back as text."""
    return (
        df.groupBy(group)
        .agg(
            F.sum(sizes.parse_size(F.col(size))).alias("bytes"),
            F.sum(sizes.parse_time(F.col(time))).alias("millis"),
        )
        .withColumn("size_txt", sizes.format_size(F.col("bytes")))
        .withColumn("time_txt", sizes.format_time(F.col("millis")))
    )
