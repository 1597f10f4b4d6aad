"""A paced reader: every file of a folder is read at a fixed number of bytes a trigger.

With a trigger every second this is a limit of bytes a second for each file. All files
advance together, so the offset of the stream is one number, whatever the number of
files; what is to be read lies in a written table, a part for each task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lakeaudit.session import new_path
from lakeaudit.sources.listing import open_root, qualified

SCHEMA = "path string, start bigint, length bigint"
_CHUNK = 4 * 1024 * 1024
_FILES = 10_000
# What a task has to read in a trigger, at least, before there is another one.
_TASK_BYTES = 8 << 20
_TASK_FILES = 1_000


class _Stretch(InputPartition):
    """The bytes from ``start`` to ``end`` of every file of one part of the table."""

    def __init__(self, part: int, start: int, end: int):
        self.part, self.start, self.end = part, start, end


class _PacedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.table = options["root"], options["table"]
        self.step = int(options["step"])
        self.longest = {int(part): length for part, length in json.loads(options["longest"]).items()}
        self.at = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": min(max(self.longest.values(), default=0), self.at + self.step)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a restarted query asks for an empty range first, which brings the position back
        self.at = end["at"]
        if start["at"] >= end["at"]:
            return []
        return [_Stretch(part, start["at"], end["at"]) for part, length in self.longest.items() if length > start["at"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(self.root)
        store, top = open_root(self.table)
        files = ds.dataset(f"{top.rstrip('/')}/part={partition.part}", filesystem=store, format="parquet")
        for batch in files.to_batches(columns=["path"], filter=ds.field("length") > partition.start, batch_size=_FILES):
            paths = batch.column("path").to_pylist()
            if paths:
                found = [_bytes_read(fs, f"{base.rstrip('/')}/{p}", partition.start, partition.end) for p in paths]
                starts = pa.array([partition.start] * len(paths), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(paths), starts, pa.array(found, pa.int64())], ["path", "start", "length"])


class PacedBytes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paced_bytes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PacedReader(dict(self.options))


def _bytes_read(fs, path: str, start: int, end: int) -> int | None:
    """Bytes read between two places; fewer in a file that became shorter, None in one that is gone."""
    size = 0
    try:
        with fs.open_input_file(path) as file:
            if start < file.size():
                file.seek(start)
                while size < end - start and (got := len(file.read(min(_CHUNK, end - start - size)))):
                    size += got
    except FileNotFoundError:
        return None
    return size


def paced_read(spark: SparkSession, root: str, files: DataFrame, step: int, parts: int | None = None) -> DataFrame:
    """A stream of (path, start, length): ``step`` bytes of every file of ``files`` (path, length) at each trigger.

    Paths are relative to ``root``; ``length`` in the result is what was really read, null for a file that
    is gone. Files are dealt over ``parts`` tasks, by default one for each 8 MB or 1,000 files of a trigger, up to
    the shuffle partitions; a task whose files have all ended is not started. Empty files and files of null
    length give no row. The position is kept in the query's checkpoint; the same ``files`` must be named after a restart.
    """
    if step < 1:
        raise ValueError("step must be at least one byte")
    table = new_path(spark, "paced")
    dealt = files.select("path", F.col("length").cast("bigint").alias("length")).where("length > 0")
    if not parts:
        n, size = dealt.agg(F.count("*"), F.sum(F.least("length", F.lit(step)))).first()
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(-(-n // _TASK_FILES), -(-(size or 0) // _TASK_BYTES))))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
    dealt.repartition(parts, "part").write.partitionBy("part").parquet(table)
    # one number for each task
    longest = spark.read.schema("length bigint, part int").parquet(table).groupBy("part").agg(F.max("length").alias("length")).orderBy("part").collect()
    spark.dataSource.register(PacedBytes)
    options = {"root": qualified(spark, root), "table": qualified(spark, table), "step": step, "longest": json.dumps({r["part"]: r["length"] for r in longest})}
    return spark.readStream.format("paced_bytes").options(**options).load()


def drain(stream: DataFrame, out: str, checkpoint: str, interval: str = "0 seconds") -> None:
    """Writes the rows of every trigger below ``out`` with its number, until all files are read.

    ``interval`` is the time between triggers: with one second, the step is a rate of bytes a second.
    A trigger that is repeated replaces its rows.
    """
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def paced_totals(spark: SparkSession, out: str) -> DataFrame:
    """(path, length, triggers, most): bytes read of each file, in how many triggers, and most in one."""
    return (
        spark.read.parquet(out)
        .groupBy("path")
        .agg(F.sum("length").alias("length"), F.count_distinct("batch").alias("triggers"), F.max("length").alias("most"))
    )
