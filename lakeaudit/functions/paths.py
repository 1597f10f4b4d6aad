"""Path expressions. Paths are relative to the listed root, which is ``''``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Parent path; ``''`` for first-level entries, NULL for the root itself."""
    keep = F.length(path) - F.length(name_of(path)) - 1
    return F.when(path != "", F.substring(path, F.lit(1), F.greatest(keep, F.lit(0))))


def segments_of(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def depth_of(path: Column) -> Column:
    """Number of segments: 0 for the root."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(path == "", F.lit(0)).otherwise(slashes + 1)


def ancestors_of(path: Column) -> Column:
    """Every proper ancestor from the root down; empty for the root."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), depth_of(path) - 1),
            lambda i: F.call_function("substring_index", path, F.lit("/"), i),
        )
    )


def dfs_key(path: Column) -> Column:
    """String whose byte order is the order of a name-sorted depth-first walk.

    ``/`` becomes the smallest character, so ``a`` < ``a/b`` < ``a-b`` as in a
    walk. It equals comparing segment arrays, at the price of a string sort.
    """
    return F.replace(path, F.lit("/"), F.lit("\u0000"))


def from_dfs_key(key: Column) -> Column:
    return F.replace(key, F.lit("\u0000"), F.lit("/"))


def rel_path(path: Column, root: str | Column) -> Column:
    """``path`` cut at the length of ``root``; a leading ``/`` stays."""
    length = F.lit(len(root)) if isinstance(root, str) else F.length(root)
    return F.substring(path, length + 1, F.lit(2**31 - 1))


def strip_scheme(uri: Column) -> Column:
    """``hdfs:/a`` or ``hdfs://host/a`` without the scheme and its colon."""
    return F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*:", "")


def is_hidden(name: Column) -> Column:
    return name.startswith(".")
