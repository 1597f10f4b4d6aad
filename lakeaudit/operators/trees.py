"""Comparing two listings, or a listing with its expected layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.operators.inventory import drop_hidden
from lakeaudit.operators.skew import HOT_ROWS, hot_keys, salted_join


def tree_diff_missing(target: DataFrame, base: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Topmost entries of ``target`` that ``base`` lacks, hidden names skipped.

    An entry is topmost if its parent is a directory on both sides, so a walk
    in step would reach it; the content of a missing directory is not listed.
    """
    visible = drop_hidden(target)
    missing = visible.join(base.select("path"), "path", "left_anti")
    shared = base.where(F.col("is_dir")).select(F.col("path").alias("parent"))
    found = salted_join(
        missing, shared, "parent", ["path"], "left_semi", hot=hot_keys(visible, "parent", hot_rows)
    )
    return found.select("path", "is_dir")


def tree_diff_kind(target: DataFrame, base: DataFrame) -> DataFrame:
    """Same path, a directory on one side and a file on the other.

    Both listings are whole trees, so a path on both sides has directories
    above it on both sides and a walk in step reaches it.
    """
    theirs = base.select("path", F.col("is_dir").alias("base_is_dir"))
    ours = target.select("path", F.col("is_dir").alias("target_is_dir"))
    return ours.join(theirs, "path").where(F.col("base_is_dir") != F.col("target_is_dir"))


def manifest_check(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """File rows against (path, expected_length): ok, wrong length, missing, unexpected."""
    actual = entries.where(~F.col("is_dir")).select("path", "length", F.lit(True).alias("_here"))
    wanted = manifest.select("path", "expected_length", F.lit(True).alias("_wanted"))
    status = (
        F.when(F.col("_here").isNull(), "missing")
        .when(F.col("_wanted").isNull(), "unexpected")
        .when(F.col("length") == F.col("expected_length"), "ok")
        .otherwise("wrong length")
    )
    return wanted.join(actual, "path", "full_outer").select(
        "path", "expected_length", "length", status.alias("status")
    )


def wrong_lengths(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Expected files whose length is another one, or NULL for a file that is not there."""
    actual = entries.where(~F.col("is_dir")).select("path", "length")
    return manifest.join(actual, "path", "left").where(~F.col("length").eqNullSafe(F.col("expected_length")))
