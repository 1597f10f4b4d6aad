"""Writers. Each relies on Spark's commit protocol, so a lost task is redone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.operators.kv import kv_dump_lines, newest_first_key
from lakeaudit.operators.skew import hot_keys


def write_kv(kv: DataFrame, path: str) -> None:
    """Range-sorted by key, so that row groups prune on key ranges."""
    kv.orderBy("key", "value").write.parquet(path)


def write_dump(kv: DataFrame, path: str) -> None:
    """Text files of ``key = value`` lines in key order."""
    kv_dump_lines(kv.orderBy("key", "value")).write.text(path)


def write_texts(df: DataFrame, path: str, line: str, by: list[str]) -> None:
    """A directory for each value of ``by``, with one text file of the lines of its rows."""
    df.select(*by, line).repartition(*by).write.partitionBy(*by).text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows for and keep the others."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def fanout(df: DataFrame, path: str, worker: str, max_records: int = 10_000_000) -> None:
    """One sub-directory per worker, in files of at most about ``max_records`` rows.

    Rows are counted first: a worker with at most ``max_records`` rows is one file, one with more is dealt
    over as many write tasks as it needs. Only such workers are in the broadcast table, at most rows /
    max_records of them. The input partition takes part in the deal, so that copies of one row are dealt
    out too. Rows of a null worker stay; they are dealt like those of a worker above the bound.
    """
    hot = F.broadcast(hot_keys(df, worker, max_records))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.xxhash64(*df.columns) + F.spark_partition_id()
    parts = F.when(F.col(worker).isNull(), F.lit(tasks)).otherwise(F.coalesce("_parts", F.lit(1)))
    (
        df.withColumn("_deal", deal)
        .join(hot, F.col(worker) == F.col("_hot_key"), "left")
        .withColumn("_part", F.pmod(F.col("_deal"), parts.cast("bigint")))
        .drop("_hot_key", "_parts", "_deal")
        .repartition(tasks, worker, "_part")
        .drop("_part")
        .write.option("maxRecordsPerFile", max_records)
        .partitionBy(worker)
        .parquet(path)
    )


def write_newest_first(entities: DataFrame, path: str) -> None:
    """Entities (entity_type, entity_id, start_ts) range-sorted by :func:`newest_first_key`, for :func:`seek_newest`."""
    keyed = entities.withColumn("key", newest_first_key(F.col("start_ts")))
    keyed.orderBy("key", "entity_type", "entity_id").write.parquet(path)


def register_tables(spark: SparkSession, database: str, tables: dict[str, str]) -> list[str]:
    """Register Parquet directories as external tables; returns their full names.

    A table that is there already stays if it is external and points to the same path,
    is registered anew if it is external and points to another one, and is an error if
    it is managed: dropping it would delete its data.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = []
    for name, path in tables.items():
        full = f"{database}.{name}"
        names.append(full)
        if spark.catalog.tableExists(full):
            facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {full}").collect()}
            if facts.get("Type") != "EXTERNAL":
                raise ValueError(f"{full} is no external table; it stays as it is")
            if facts.get("Location", "").rstrip("/").endswith(path.rstrip("/")):
                spark.catalog.refreshTable(full)
                continue
            spark.sql(f"DROP TABLE {full}")
        spark.catalog.createTable(full, path=path, source="parquet")
    return names
