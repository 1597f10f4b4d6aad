"""Sorted key-value pairs (key BINARY, value BINARY) and timeline entities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def kv_scan(kv: DataFrame) -> DataFrame:
    """All pairs in key order (byte-wise, unsigned); equal keys by value."""
    return kv.orderBy("key", "value")


def successor(prefix: bytes) -> bytes | None:
    """Smallest key above every key with this prefix; None if there is none."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def kv_prefix(kv: DataFrame, prefix: bytes) -> DataFrame:
    """Pairs whose key starts with ``prefix``, as a range that Parquet can prune."""
    found = F.col("key") >= F.lit(prefix)
    end = successor(prefix)
    return kv.where(found & (F.col("key") < F.lit(end)) if end is not None else found)


def kv_count_contains(kv: DataFrame, text: str) -> DataFrame:
    """One row: the number of keys that contain ``text``."""
    return kv.where(F.contains("key", F.lit(text.encode()))).agg(F.count(F.lit(1)).alias("n"))


def kv_group_count(kv: DataFrame) -> DataFrame:
    """(kind, n): pairs per first key byte; an empty key counts under ``' '``.

    The true count; nothing is counted twice.
    """
    first = F.when(F.octet_length("key") == 0, F.lit(b" ")).otherwise(F.substring("key", 1, 1))
    return (
        kv.groupBy(first.alias("_b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.decode("_b", "ISO-8859-1").alias("kind"), "n")
    )


def kv_dump_lines(kv: DataFrame) -> DataFrame:
    """(line): ``key = value`` as text, one row per pair."""
    text: Column = F.concat(F.col("key").cast("string"), F.lit(" = "), F.col("value").cast("string"))
    return kv.select(text.alias("line"))


def map_kv(kv: DataFrame, fn: Callable[[Iterator], Iterator], schema: StructType | str, arrow: bool = False) -> DataFrame:
    """Run the caller's function over batches of pairs, on the executors.

    It takes and gives pandas frames, or with ``arrow`` record batches.
    """
    pairs = kv.select("key", "value")
    return pairs.mapInArrow(fn, schema) if arrow else pairs.mapInPandas(fn, schema)


def seek_desc(entities: DataFrame, ts: Column, limit: int | None = None) -> DataFrame:
    """Entities at or before ``ts``, newest first.

    Type and id break ties, which also splits a moment shared by many rows
    over several sort ranges.
    """
    found = entities.where(F.col("start_ts") <= ts).orderBy(
        F.desc("start_ts"), "entity_type", "entity_id"
    )
    return found if limit is None else found.limit(limit)


def newest_first_key(ts: Column) -> Column:
    """Eight bytes whose order is the reverse of time's, so that the newest come first in a table sorted by them."""
    flipped = F.unix_micros(ts.cast("timestamp")).bitwiseXOR(F.lit(2**63 - 1))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def seek_newest(stored: DataFrame, ts: Column, limit: int | None = None) -> DataFrame:
    """Entities at or before ``ts`` of a table that :func:`sinks.write_newest_first` wrote.

    What is sought is a range of ``key``, from the moment's key on; it reaches the scan and skips all
    newer row groups. Without ``limit`` nothing is sorted: rows come as the files hold them and ``key``
    tells their order. With it, the first ``limit`` are found by heaps, ties by type and id.
    """
    found = stored.where(F.col("key") >= newest_first_key(ts))
    return found if limit is None else found.orderBy("key", "entity_type", "entity_id").limit(limit)


def entity_types(entities: DataFrame) -> DataFrame:
    return entities.select("entity_type").distinct()


def entity_ttl(entities: DataFrame, ts: Column) -> DataFrame:
    """(entity_type, kept, discarded) after dropping what started at or before ``ts``."""
    return entities.groupBy("entity_type").agg(
        F.count_if(F.col("start_ts") > ts).alias("kept"),
        F.count_if(F.col("start_ts") <= ts).alias("discarded"),
    )


def on_exact_day(df: DataFrame, ts: str, ref: Column, days_back: int = 30) -> DataFrame:
    """Rows dated exactly ``days_back`` days before ``ref``, not older ones.

    A half-open range on the raw column, so that it reaches the scan.
    """
    day = F.date_sub(ref, days_back)
    lower, upper = day.cast("timestamp_ntz"), F.date_add(day, 1).cast("timestamp_ntz")
    return df.where((F.col(ts) >= lower) & (F.col(ts) < upper))
