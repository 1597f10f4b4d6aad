"""Directory trees as an ``entries`` DataFrame, listed by the executors.

Two ways in: ``spark.read.format("fs_listing").load(root)`` is lazy and walks
one group of sub-trees per task; :func:`list_tree` goes level by level, deals
the directories of each level over all tasks and keeps every level as a written
table, so neither a deep nor a lopsided tree leaves one task with the work.

Both reach any file system that Arrow reaches (local, hdfs, s3, …). Paths are
relative to the root; a directory that vanishes during the walk is skipped. The children of a
directory pass in batches; only systems that hand out a directory as one list hold it whole.
"""

from __future__ import annotations

import contextlib
import os
from collections import deque
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakeaudit.functions import paths
from lakeaudit.session import new_path

SCHEMA = "path string, is_dir boolean, length bigint, mtime timestamp, listed boolean"
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("is_dir", pa.bool_()),
        ("length", pa.int64()),
        ("mtime", pa.timestamp("us", tz="UTC")),
        ("listed", pa.bool_()),
    ]
)
_BATCH = 10_000


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as Spark itself would resolve it, with scheme and host."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path and the path within it."""
    scheme, _, rest = root.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        return pafs.FileSystem.from_uri("s3:" + rest)
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _join(parent: str, name: str) -> str:
    return f"{parent}/{name}" if parent else name


def _infos(fs: pafs.FileSystem, where: str) -> Iterator[tuple]:
    """(name, is_dir, length, mtime) of a directory's children, one after the other where the system can stream them."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(where) as found:
            for entry in found:
                with contextlib.suppress(FileNotFoundError):  # gone meanwhile, or a link to nothing
                    facts = entry.stat()
                    yield entry.name, entry.is_dir(), facts.st_size, datetime.fromtimestamp(facts.st_mtime, timezone.utc)
        return
    for info in fs.get_file_info(pafs.FileSelector(where, recursive=False)):
        if info.type != pafs.FileType.NotFound:
            yield info.base_name, info.type == pafs.FileType.Directory, info.size, info.mtime


def _children(fs: pafs.FileSystem, base: str, rel: str) -> Iterator[tuple]:
    """Rows of one directory's children; none if it is gone. One that may not be read is a PermissionError."""
    try:
        for name, is_dir, length, mtime in _infos(fs, f"{base.rstrip('/')}/{rel}" if rel else base):
            yield _join(rel, name), is_dir, 0 if is_dir else length, mtime, True
    except FileNotFoundError:
        return


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, never more than a batch of them at a time."""
    rows = iter(rows)
    while part := list(islice(rows, _BATCH)):
        arrays = [pa.array(c, type=f.type) for c, f in zip(zip(*part), _ARROW)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _root_row(fs: pafs.FileSystem, base: str) -> tuple:
    info = fs.get_file_info(base)
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(f"{base} is no directory")
    return ("", True, 0, info.mtime, True)


class _Share(InputPartition):
    """What one task lists: ``flat`` without going deeper, ``whole`` to the bottom."""

    def __init__(self, flat: list[str], whole: list[str]):
        self.flat, self.whole = flat, whole


class ListingReader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[InputPartition]:
        """Widen the tree breadth-first until there is a sub-tree for every task, with a call for each task at most.

        Only directory names are kept. The tasks list the directories again, so
        no files pass through the driver.
        """
        fs, base = open_root(self.root)
        _root_row(fs, base)
        opened: list[str] = []
        waiting = deque([""])
        while waiting and len(waiting) < self.tasks and len(opened) < self.tasks:
            rel = waiting.popleft()
            opened.append(rel)
            waiting.extend(r[0] for r in _children(fs, base, rel) if r[1])
        n = max(1, min(self.tasks, max(len(opened), len(waiting))))
        whole = list(waiting)
        return [_Share(opened[i::n], whole[i::n]) for i in range(n)]

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(self.root)
        if "" in partition.flat + partition.whole:
            yield from _batches([_root_row(fs, base)])
        for rel in partition.flat:
            yield from _batches(_children(fs, base, rel))
        stack = list(partition.whole)
        while stack:
            for batch in _batches(_children(fs, base, stack.pop())):
                stack.extend(batch.column("path").filter(batch.column("is_dir")).to_pylist())
                yield batch


class ListingSource(DataSource):
    """``spark.dataSource.register(ListingSource)`` makes ``fs_listing`` known."""

    @classmethod
    def name(cls) -> str:
        return "fs_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], int(self.options.get("tasks", "64")))


def with_names(entries: DataFrame) -> DataFrame:
    """Adds parent and name."""
    path = F.col("path")
    return entries.withColumn("parent", paths.parent_of(path)).withColumn("name", paths.name_of(path))


def fs_listing(spark: SparkSession, root: str, tasks: int = 64) -> DataFrame:
    spark.dataSource.register(ListingSource)
    source = spark.read.format("fs_listing").option("tasks", tasks)
    return with_names(source.load(qualified(spark, root)))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Level-by-level listing; one Spark job per level of the tree.

    A directory that may not be read stays, with ``listed`` false.
    """
    root = qualified(spark, root)
    fs, base = open_root(root)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = new_path(spark, "listing")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_fs, task_base = open_root(root)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                try:
                    yield from _batches(_children(task_fs, task_base, rel))
                except PermissionError:
                    yield from _batches([(rel, True, 0, None, False)])

    spark.createDataFrame([_root_row(fs, base)], SCHEMA).write.parquet(f"{out}/level=0")
    level = 0
    while True:
        here = spark.read.schema(SCHEMA).parquet(f"{out}/level={level}")
        frontier = here.where(F.col("is_dir") & F.col("listed")).select("path")
        if frontier.isEmpty():
            break
        level += 1
        spread = frontier.repartition(tasks, "path")
        spread.mapInArrow(expand, SCHEMA).write.parquet(f"{out}/level={level}")
    rows = spark.read.schema(SCHEMA).parquet(*[f"{out}/level={i}" for i in range(level + 1)])
    # An unreadable directory appears twice: as a child, and as not listed.
    bad = rows.where(~F.col("listed")).select("path", F.lit(True).alias("_bad"))
    marked = (
        rows.where("listed")
        .join(bad, "path", "left")
        .withColumn("listed", F.col("_bad").isNull())
        .drop("_bad")
    )
    return with_names(marked)


# --- reading files whole, to check their length ----------------------------

_RANGE = 128 * 1024 * 1024
_CHUNK = 4 * 1024 * 1024


def read_lengths(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(path, expected_length, length): bytes really read from every file of a manifest.

    Each file is cut into ranges of 128 MiB by the size that the file system reports, the last
    one open-ended, so a large file is read by many tasks, none is held in
    memory, and a wrong expected length costs nothing. A missing file gives a NULL length.
    """
    root = qualified(spark, root)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                info = fs.get_file_info(f"{base.rstrip('/')}/{row[0]}")
                if info.type != pafs.FileType.File:
                    yield _ranges([(*row, None, None)])
                    continue
                last = max(info.size - 1, 0) // _RANGE
                for at in range(0, last + 1, _BATCH):
                    yield _ranges([(*row, i * _RANGE, i == last) for i in range(at, min(at + _BATCH, last + 1))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        for batch in batches:
            path, expected, start, last = (c.to_pylist() for c in batch.columns)
            found = [_count(fs, f"{base.rstrip('/')}/{p}", s, x) for p, s, x in zip(path, start, last)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], ["path", "expected_length", "length"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.select("path", F.col("expected_length").cast("bigint")).repartition(tasks, "path").mapInArrow(
        sized, "path string, expected_length bigint, start bigint, last boolean"
    )
    return (
        ranges.repartition(tasks, "path", "start")
        .mapInArrow(read, "path string, expected_length bigint, length bigint")
        .groupBy("path", "expected_length")
        .agg(F.when(F.count("length") == F.count(F.lit(1)), F.sum("length")).alias("length"))
    )


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "expected_length": pa.int64(), "start": pa.int64(), "last": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def _count(fs: pafs.FileSystem, path: str, start: int | None, last: bool | None) -> int | None:
    """Bytes read of one range; None for a file that is not there."""
    if start is None:
        return None
    size, left = 0, None if last else _RANGE
    try:
        with fs.open_input_file(path) as file:
            if start > file.size():
                return 0
            file.seek(start)
            while left is None or left > 0:
                got = len(file.read(_CHUNK if left is None else min(_CHUNK, left)))
                if not got:
                    break
                size += got
                left = None if left is None else left - got
    except FileNotFoundError:
        return None
    return size


def read_verify(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Files that are missing or whose read length is not the expected one."""
    lengths = read_lengths(spark, root, manifest)
    return lengths.where(~F.col("length").eqNullSafe(F.col("expected_length")))
