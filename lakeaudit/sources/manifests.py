"""Expected-path tables, generated from a table of layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.numbers import div

_BLOCK = 65_536


def _expand(df: DataFrame, count: str, out: str) -> DataFrame:
    """One row per number 0 … count-1 of every input row.

    Counts are first cut into blocks and the blocks dealt over all tasks, so a
    layout with a huge count neither builds a huge array nor stays in one task.
    The number of partitions is explicit since block rows are far smaller than
    what they grow into.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = div(F.col(count) - 1, _BLOCK)
    blocks = (
        df.where(F.col(count) > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .repartition(tasks, *df.columns, "_block")
    )
    first = F.col("_block") * _BLOCK
    end = F.least(first + _BLOCK, F.col(count)) - 1
    return blocks.withColumn(out, F.explode(F.sequence(first, end))).drop("_block")


def _numbered(label: str, number: Column) -> Column:
    return F.concat(F.lit(label), number.cast("string"))


def gen_manifest(layouts: DataFrame) -> DataFrame:
    """(path) of every file; layouts have thread, subdirs and files (BIGINT)."""
    total = layouts.withColumn("_total", F.col("subdirs") * F.col("files"))
    i = F.col("_i")
    path = F.concat_ws(
        "/",
        _numbered("thread_", F.col("thread")),
        _numbered("subdir_", div(i, F.col("files"))),
        _numbered("file_", i % F.col("files")),
    )
    return _expand(total, "_total", "_i").select(path.alias("path"))


def _product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1).cast("bigint"), lambda acc, x: acc * x)


def _tree(layouts: DataFrame, dir_label: str) -> DataFrame:
    """(dir, _file): every leaf directory, repeated for each of its ``files``.

    All level numbers follow from the position of a row by division, so no
    level is joined to the next.
    """
    below = F.transform(
        "_dims", lambda _, j: _product(F.slice(F.col("_dims"), j + 2, F.size("_dims")))
    )
    sized = (
        layouts.withColumn("_dims", F.col("dirs_per_level").cast("array<bigint>"))
        .withColumn("_below", below)
        .withColumn("_total", _product(F.col("_dims")) * F.col("files"))
        .select("thread", "files", "_dims", "_below", "_total")
    )
    leaf = div(F.col("_i"), F.col("files"))
    levels = F.zip_with("_dims", "_below", lambda d, b: _numbered(dir_label, div(leaf, b) % d))
    return _expand(sized, "_total", "_i").select(
        F.concat_ws("/", _numbered("d", F.col("thread")), levels).alias("dir"),
        (F.col("_i") % F.col("files")).alias("_file"),
    )


def gen_tree_manifest(
    layouts: DataFrame, dir_label: str = "d", file_label: str = "f", suffixes: tuple[str, ...] = ("",)
) -> DataFrame:
    """(path) of every file for a fan-out per level.

    Layouts have thread, dirs_per_level (int array) and files per leaf. With
    ``file_label="blk_"`` and ``suffixes=("", ".meta")`` each file is a pair.
    """
    path = F.concat_ws("/", "dir", _numbered(file_label, F.col("_file")))
    rows = _tree(layouts, dir_label).select(path.alias("path"))
    if suffixes == ("",):
        return rows
    ends = F.explode(F.array(*map(F.lit, suffixes)))
    return rows.withColumn("_end", ends).select(F.concat("path", "_end").alias("path"))


def gen_dir_manifest(layouts: DataFrame, dir_label: str = "d") -> DataFrame:
    """(path) of every directory on every level below each thread's own."""
    upto = F.explode(F.sequence(F.lit(1), F.size("dirs_per_level")))
    cut = (
        layouts.where(F.size("dirs_per_level") > 0)
        .withColumn("_level", upto)
        .withColumn("dirs_per_level", F.expr("slice(dirs_per_level, 1, _level)"))
        .withColumn("files", F.lit(1).cast("bigint"))
    )
    return _tree(cut, dir_label).select(F.col("dir").alias("path"))
