"""Duplicate files by name and size, in the order of a depth-first walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeaudit.functions import paths
from lakeaudit.operators.ordered import block_totals, from_blocks, in_blocks


def _quoted(path: Column) -> Column:
    """A path as one word of a shell command, whatever characters it has."""
    return F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def _columns(path: Column, rep: Column) -> list[Column]:
    return [
        path.alias("path"),
        rep.alias("rep"),
        F.concat(F.lit("rm -rf "), _quoted(path)).alias("rm_cmd"),
        F.concat(F.lit("ln -s "), _quoted(rep), F.lit(" "), _quoted(path)).alias("ln_cmd"),
    ]


def _mark_runs(files: DataFrame) -> DataFrame:
    """Runs of equal consecutive sizes within (name, _block); ``rep`` is a run's first key."""
    w = W.partitionBy("name", "_block").orderBy("_key")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    same = F.col("length").eqNullSafe(F.lag("length").over(w)) & (F.row_number().over(w) > 1)
    return (
        files.withColumn("_row", F.row_number().over(w))
        .withColumn("_new", F.when(same, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(so_far))
        .withColumn("rep", F.last(F.when(F.col("_new") == 1, F.col("_key")), True).over(so_far))
    )


def _carry(marked: DataFrame) -> DataFrame:
    """(name, _block, _in_rep): the representative a block's first run continues.

    The state of a block is its first and last size, its last representative and its number of
    runs; states of neighbours merge. Works on one row per block of a cut name.
    """
    blocks = block_totals(marked, ["name"], [
        F.min_by("length", "_key").alias("_first"),
        F.max_by("length", "_key").alias("_last"),
        F.max_by("rep", "_key").alias("_rep"),
        F.max("_run").alias("_runs"),
    ])
    w = W.partitionBy("name").orderBy("_block")
    joins = F.col("_first").eqNullSafe(F.lag("_last").over(w)) & (F.row_number().over(w) > 1)
    # A block of one run that continues keeps the representative it received.
    own = F.when((F.col("_runs") > 1) | ~F.col("_joins"), F.col("_rep"))
    return (
        blocks.withColumn("_joins", joins)
        .withColumn("_out", F.last(own, True).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_in_rep", F.when(F.col("_joins"), F.lag("_out").over(w)))
        .select("name", "_block", "_in_rep")
    )


def dup_files(entries: DataFrame, parts: int | None = None) -> DataFrame:
    """(path, rep, rm_cmd, ln_cmd) for every duplicate file.

    Walking depth-first, the last representative of each name is kept: a file
    of the same size is its duplicate, one of another size takes its place.
    That makes runs of equal consecutive sizes within a name.

    Names are cut into blocks by their share of the files (``ordered.in_blocks``), runs are found per block,
    and the first run of a block takes over the representative of the blocks before
    it, through one row per block of a cut name.
    """
    # The sort key stands for the path until the end, so only one of them is shuffled.
    files = entries.where(~F.col("is_dir")).select(
        "name", "length", paths.dfs_key(F.col("path")).alias("_key")
    )
    marked = _mark_runs(in_blocks(files, ["name"], "_key", parts).repartition("name", "_block"))
    rep = F.when(F.col("_run") == 1, F.coalesce("_in_rep", "rep")).otherwise(F.col("rep"))
    found = from_blocks(marked, ["name"], _carry(marked)).where((F.col("_new") == 0) | F.col("_in_rep").isNotNull())
    found = found.where((F.col("_new") == 0) | (F.col("_row") == 1)).select("_key", rep.alias("rep"))
    return found.select(*_columns(paths.from_dfs_key(F.col("_key")), paths.from_dfs_key(F.col("rep"))))
