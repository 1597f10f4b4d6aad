"""Readers for text reports and key-value exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 1 per file.

    A large file is read in splits. Lines are numbered within their split and
    moved by the line count of the splits before it, so no file is whole in one
    task and the per-file step sees one row per split.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    before = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        raw.groupBy("file", "_start")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    here = F.row_number().over(W.partitionBy("file", "_start").orderBy("_id"))
    return (
        raw.withColumn("_row", here)
        .join(offsets, ["file", "_start"])
        .select("file", (F.col("_row") + F.col("_before")).alias("line_no"), "line")
    )


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """An exported key-value table; see ``sinks.write_kv`` for its layout."""
    return spark.read.schema("key binary, value binary").parquet(path)
