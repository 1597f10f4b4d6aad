"""Questions asked of one directory listing.

``entries`` has path, is_dir, length, mtime, parent and name; paths are relative
to the root, whose own row has path ``''`` and a NULL parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions import paths
from lakeaudit.operators.skew import HOT_ROWS, as_hot, salted_join


def children(entries: DataFrame, root: str) -> DataFrame:
    """The immediate children of one directory: what dropping it would remove."""
    return entries.where(F.col("parent") == root)


def drop_hidden(entries: DataFrame) -> DataFrame:
    return entries.where(~paths.is_hidden(F.col("name")))


def _counts_by_parent(entries: DataFrame) -> DataFrame:
    return (
        entries.where(F.col("parent").isNotNull())
        .groupBy(F.col("parent").alias("path"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _dirs(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("is_dir"))


def dir_child_count(entries: DataFrame) -> DataFrame:
    """(path, n) for every directory, empty ones and the root included."""
    return (
        _dirs(entries)
        .select("path")
        .join(_counts_by_parent(entries), "path", "left")
        .select("path", F.coalesce("n", F.lit(0)).alias("n"))
    )


def top_dirs(entries: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` directories with most direct children, ties by path ascending.

    No join is needed. Fewer than ``n`` rows in the first part mean that it
    lists every non-empty directory; then the first ``n`` directories by path
    hold enough empty ones to fill up, and the maximum drops the others.
    """
    order = [F.desc("n"), F.asc("path")]
    busiest = _counts_by_parent(entries).orderBy(*order).limit(n)
    fill = (
        _dirs(entries).select("path", F.lit(0).cast("bigint").alias("n")).orderBy("path").limit(n)
    )
    return (
        busiest.unionByName(fill).groupBy("path").agg(F.max("n").alias("n")).orderBy(*order).limit(n)
    )


def empty_dirs(entries: DataFrame) -> DataFrame:
    """Directories with no entries at all; one that holds only files is not empty."""
    return dir_child_count(entries).where(F.col("n") == 0).select("path")


def _list_wrong(
    entries: DataFrame, counts: DataFrame, expected: int, hot_rows: int
) -> DataFrame:
    """(path, n, child) below every directory in ``counts`` with n <> expected."""
    hot = as_hot(counts.select(F.col("path").alias("_hot_key"), F.col("n").alias("_n")), hot_rows)
    return salted_join(
        entries.select(F.col("parent").alias("path"), F.col("name").alias("child")),
        counts.where(F.col("n") != expected),
        "path",
        spread=["child"],
        hot=hot,
    ).select("path", "n", "child")


def wrong_counts(entries: DataFrame, expected: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`dir_expect_count` for the non-empty directories alone."""
    return _list_wrong(entries, _counts_by_parent(entries), expected, hot_rows)


def dir_expect_count(entries: DataFrame, expected: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Children of every directory whose child count differs from ``expected``.

    One row per child (path, n, child), and one with a NULL child for an empty
    directory: a directory may hold a large share of all entries, so its
    children are never gathered in one array. Its rows are dealt over salts.
    """
    listed = wrong_counts(entries, expected, hot_rows)
    if expected == 0:
        return listed
    none = empty_dirs(entries).select(
        "path", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("child")
    )
    return listed.unionByName(none)


# --- retention -------------------------------------------------------------


def expired_files(entries: DataFrame, cutoff: Column) -> DataFrame:
    """Files modified strictly before ``cutoff``."""
    return entries.where(~F.col("is_dir") & (F.col("mtime") < cutoff))


def cutoff_before(now: Column, hours: int = 0, days: int = 0) -> Column:
    """``now`` minus a number of hours and days, in 64 bits."""
    return now - F.make_interval(hours=F.lit(hours), days=F.lit(days))


def removable_dirs(entries: DataFrame, cutoff: Column) -> DataFrame:
    """(path, own_old, removable): all descendants and itself older than ``cutoff``.

    An old directory without content is removable. If the listing has a
    ``listed`` column, a directory that could not be listed is not removable,
    nor is anything above it. Files are first combined into their parent, and
    only directories are expanded to their ancestors.
    """
    old = F.col("mtime") < cutoff
    files = (
        entries.where(~F.col("is_dir"))
        .groupBy(F.col("parent").alias("path"))
        .agg(F.bool_and(old).alias("files_old"))
    )
    own_old = old & F.col("listed") if "listed" in entries.columns else old
    dirs = (
        _dirs(entries)
        .select("path", own_old.alias("own_old"))
        .join(files, "path", "left")
        .withColumn("_all", F.col("own_old") & F.coalesce("files_old", F.lit(True)))
    )
    up = F.array_append(paths.ancestors_of(F.col("path")), F.col("path"))
    return (
        dirs.select(
            F.posexplode(F.reverse(up)).alias("_up", "dir"), "own_old", "_all"
        )
        .groupBy(F.col("dir").alias("path"))
        .agg(
            F.bool_and(F.when(F.col("_up") == 0, F.col("own_old"))).alias("own_old"),
            F.bool_and("_all").alias("removable"),
        )
        .where(F.col("own_old").isNotNull())
    )


def retention_plan(entries: DataFrame, cutoff: Column) -> DataFrame:
    """(path, is_dir, action, reason) for every entry; a plan, nothing is deleted."""
    old = F.col("mtime") < cutoff
    files = entries.where(~F.col("is_dir")).select(
        "path",
        F.lit(False).alias("is_dir"),
        F.when(old, "delete").otherwise("keep").alias("action"),
        F.when(old, "file older than cutoff").otherwise("file not older than cutoff").alias("reason"),
    )
    dirs = removable_dirs(entries, cutoff).select(
        "path",
        F.lit(True).alias("is_dir"),
        F.when(F.col("removable"), "delete").otherwise("keep").alias("action"),
        F.when(F.col("removable"), "directory and content older than cutoff")
        .when(F.col("own_old"), "content is kept")
        .otherwise("directory not older than cutoff")
        .alias("reason"),
    )
    return files.unionByName(dirs)
