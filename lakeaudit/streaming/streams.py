"""Streaming jobs over the operation log and over listings.

Each job is a transformation of a streaming DataFrame plus a runner that drains
what is available and stops; long-running use starts the same transformation
with another trigger.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeaudit.operators.inventory import wrong_counts
from lakeaudit.operators.skew import HOT_ROWS


class LayoutAlert(RuntimeError):
    """A directory has a wrong number of children."""


def read_files(
    spark: SparkSession,
    path: str,
    schema: StructType,
    max_files: int | None = None,
    max_bytes: str | None = None,
) -> DataFrame:
    """A Parquet file stream, limited per trigger by files or by bytes."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def op_rollup(log: DataFrame, window: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Count and longest time per op and tumbling window; later rows are dropped.

    Event times without a zone are read in the session's and written back so.
    Works on a batch too, where the watermark has no effect.
    """
    return (
        log.select(F.col("start_ts").cast("timestamp").alias("ts"), "op", "elapsed")
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "op")
        .agg(F.count(F.lit(1)).alias("n"), F.max("elapsed").alias("max_elapsed"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "op",
            "n",
            "max_elapsed",
        )
    )


def worker_max(log: DataFrame) -> DataFrame:
    """Count and longest time per worker, kept across micro-batches and restarts."""
    return log.groupBy("worker").agg(
        F.count(F.lit(1)).alias("calls"), F.max("elapsed").alias("max_elapsed")
    )


def drain_append(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write finished rows to Parquet until the source is drained."""
    (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def drain_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write changed rows per micro-batch; a repeated batch replaces itself.

    An empty part comes first, so that the schema is there without any batch.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def latest_rollup(spark: SparkSession, out: str) -> DataFrame:
    """Current state of every window from the updates of :func:`op_rollup`; both values only grow."""
    return (
        spark.read.parquet(out)
        .groupBy("window_start", "window_end", "op")
        .agg(F.max("n").alias("n"), F.max("max_elapsed").alias("max_elapsed"))
    )


def drain_rollup_with_late(
    log: DataFrame, out: str, checkpoint: str, window: str = "10 seconds", delay: str = "10 seconds"
) -> None:
    """The rollup of :func:`op_rollup` with every row that came too late kept in a side table.

    ``log`` has start_ts, op, elapsed and any further columns. As with Spark's own watermark, a row is late
    if its window ends no later than ``delay`` before the greatest time of all earlier micro-batches. Late rows,
    and rows without a time, go to ``out``/late whole; all others are rolled up, one small table per batch. A
    repeated batch replaces itself. So :func:`rollup_with_late` and :func:`late_rows` together hold every row.
    """
    spark = log.sparkSession
    window_end = F.window(F.col("start_ts").cast("timestamp"), window).getField("end")

    def keep(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        before = F.lit(None).cast("timestamp")
        if number > 0:
            before = F.lit(own.read.parquet(f"{out}/top/batch={number - 1}").first()["top"]).cast("timestamp")
        closed = before - F.expr(f"interval {delay}")
        late = F.col("start_ts").isNull() | F.coalesce(F.col("_end") <= closed, F.lit(False))
        # a window of a null time would take the row away
        timed = batch.where("start_ts is not null").withColumn("_end", window_end)
        rows = timed.unionByName(batch.where("start_ts is null"), allowMissingColumns=True).withColumn("_late", late).persist()
        try:
            rows.where("_late").drop("_late", "_end").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
            _rolled(rows.where("not _late"), window).write.mode("overwrite").parquet(f"{out}/windows/batch={number}")
            top = rows.agg(F.greatest(F.max(F.col("start_ts").cast("timestamp")), before).alias("top"))
            top.write.mode("overwrite").parquet(f"{out}/top/batch={number}")
        finally:
            rows.unpersist()

    spark.createDataFrame([], log.schema).write.mode("append").parquet(f"{out}/late/batch=-1")
    _rolled(spark.createDataFrame([], log.schema), window).write.mode("append").parquet(f"{out}/windows/batch=-1")
    (
        log.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _rolled(log: DataFrame, window: str) -> DataFrame:
    return (
        log.groupBy(F.window(F.col("start_ts").cast("timestamp"), window).alias("w"), "op")
        .agg(F.count(F.lit(1)).alias("n"), F.max("elapsed").alias("max_elapsed"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "op",
            "n",
            "max_elapsed",
        )
    )


def rollup_with_late(spark: SparkSession, out: str) -> DataFrame:
    """Windows as :func:`drain_rollup_with_late` wrote them."""
    return (
        spark.read.parquet(f"{out}/windows")
        .groupBy("window_start", "window_end", "op")
        .agg(F.sum("n").alias("n"), F.max("max_elapsed").alias("max_elapsed"))
    )


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows left out of :func:`rollup_with_late`, with the number of the batch that brought them."""
    return spark.read.parquet(f"{out}/late")


def latest_worker_max(spark: SparkSession, out: str) -> DataFrame:
    """Current state from the updates of :func:`worker_max`; both values only grow."""
    return (
        spark.read.parquet(out)
        .groupBy("worker")
        .agg(F.max("calls").alias("calls"), F.max("max_elapsed").alias("max_elapsed"))
    )


def drain_expect_alert(
    entries: DataFrame,
    expected: int,
    out: str,
    checkpoint: str,
    stop: bool = True,
    hot_rows: int = HOT_ROWS,
) -> None:
    """Writes the children of directories whose child count differs from ``expected``; see :func:`alerts`.

    Counts run over all micro-batches, so the alerts do not depend on how the stream is
    cut. With ``stop`` the query ends at the first batch after which a directory has too
    many children; too few are known when the stream is drained. Either way the alerts
    are written first and :class:`LayoutAlert` is raised then.
    """
    spark = entries.sparkSession
    for part, schema in (("seen", entries.schema), ("counts", "parent string, n bigint")):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/{part}/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/seen/batch={number}")
        own = batch.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        own.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        if stop:
            now = batch.sparkSession.read.parquet(f"{out}/counts/batch={number}").select("parent")
            total = batch.sparkSession.read.parquet(f"{out}/counts").join(now, "parent").groupBy("parent").agg(F.sum("n").alias("n"))
            if not total.where(F.col("n") > expected).isEmpty():
                raise LayoutAlert(f"batch {number}: see {out}/alerts")

    query = (
        entries.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stopped = None
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "LayoutAlert" not in str(e):
            raise
        stopped = e
    seen = spark.read.parquet(f"{out}/seen").drop("batch")
    wrong_counts(seen, expected, hot_rows).write.mode("overwrite").parquet(f"{out}/alerts")
    if stopped or (stop and not alerts(spark, out).isEmpty()):
        raise LayoutAlert(f"see {out}/alerts") from stopped


def alerts(spark: SparkSession, out: str) -> DataFrame:
    """(path, n, child) as :func:`drain_expect_alert` wrote them."""
    return spark.read.parquet(f"{out}/alerts").select("path", "n", "child")
