"""Timed operations: (worker, seq, op, start_ts, elapsed, gc, items).

``seq`` counts each worker's operations from 1 and is unique per worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.numbers import div
from lakeaudit.operators.ordered import ranked, running


def _rows() -> Column:
    return F.count(F.lit(1))


def min_max_total(log: DataFrame) -> DataFrame:
    """Per op: calls, shortest, longest and summed duration, and the span in time."""
    start = F.unix_micros(F.col("start_ts").cast("timestamp"))
    end_us = start + F.col("elapsed") * 1000
    return log.groupBy("op").agg(
        _rows().alias("calls"),
        F.min("elapsed").alias("min_elapsed"),
        F.max("elapsed").alias("max_elapsed"),
        F.sum("elapsed").alias("total_elapsed"),
        (F.max(end_us) - F.min(start)).alias("span_us"),
    )


def slowest(log: DataFrame) -> DataFrame:
    """Per op the longest call: which worker and iteration, and when it began.

    On ties the lowest worker, then the lowest seq. The longest time is found
    first with a hash aggregate over two columns; only calls that reach it go
    through the struct comparison.
    """
    longest = log.groupBy("op").agg(F.max("elapsed").alias("elapsed"))
    first = F.min(F.struct("worker", "seq", "start_ts"))
    return (
        log.select("op", "elapsed", "worker", "seq", "start_ts")
        .join(longest, ["op", "elapsed"], "left_semi")
        .groupBy("op", "elapsed")
        .agg(first.alias("_f"))
        .select("op", "elapsed", "_f.*")
    )


def _throughput(log: DataFrame, by: str) -> DataFrame:
    """Two plain aggregates instead of a distinct one: per worker, then per group."""
    per_worker = log.groupBy(by, "worker").agg(
        F.sum("items").alias("items"), F.sum("elapsed").alias("elapsed")
    )
    return (
        per_worker.groupBy(by)
        .agg(
            _rows().alias("workers"),
            F.sum("items").alias("items"),
            F.sum("elapsed").alias("elapsed"),
        )
        .withColumn("per_sec", items_per_sec())
    )


def items_per_sec() -> Column:
    """items / (summed worker time in s / workers), as one division; NULL for no time."""
    items = F.col("items").cast("double")
    return F.try_divide(items * F.col("workers") * 1000, F.col("elapsed").cast("double"))


def throughput(log: DataFrame) -> DataFrame:
    """Per op: workers, items, summed time and items per second."""
    return _throughput(log, "op")


def mode_split(log: DataFrame, read_share: float, parts: int | None = None) -> DataFrame:
    """The same rollup by mode, where the first floor(workers * share) workers read.

    Workers are ordered by number. Both modes are always reported. The log is
    reduced to one row per worker first; the rank of a worker is then a running
    count over that table.
    """
    per_worker = log.groupBy("worker").agg(
        F.sum("items").alias("items"), F.sum("elapsed").alias("elapsed")
    )
    numbered = ranked(per_worker, [], "worker", "_rank", parts)
    readers = per_worker.agg(F.floor(_rows() * F.lit(read_share))).scalar()
    reads = F.col("_rank") <= readers

    def totals(mode: str, picked: Column) -> Column:
        return F.struct(
            F.lit(mode).alias("mode"),
            F.count_if(picked).alias("workers"),
            *[F.coalesce(F.sum(F.when(picked, F.col(c))), F.lit(0)).alias(c) for c in ("items", "elapsed")],
        )

    both = numbered.withColumn("_reads", reads).agg(
        F.array(totals("read", F.col("_reads")), totals("write", ~F.col("_reads"))).alias("_modes")
    )
    return both.select(F.inline("_modes")).withColumn("per_sec", items_per_sec())


def batch_time(log: DataFrame, batch: int) -> DataFrame:
    """Per worker and batch of ``batch`` operations; the last may be short."""
    number = div(F.col("seq") - 1, batch)
    return log.groupBy("worker", number.alias("batch")).agg(
        _rows().alias("calls"), F.sum("elapsed").alias("elapsed"), F.min("start_ts").alias("start_ts")
    )


def gc_adjusted(log: DataFrame, by: str = "seq") -> DataFrame:
    """Elapsed, GC and their difference per iteration."""
    return log.groupBy(by).agg(
        F.sum("elapsed").alias("elapsed"),
        F.sum("gc").alias("gc"),
        F.sum(F.col("elapsed") - F.col("gc")).alias("net"),
    )


def cpu_usage(log: DataFrame, cpu: str = "gc", wall: str = "elapsed") -> DataFrame:
    """CPU time, wall time and 100 * cpu / wall per op."""
    return (
        log.groupBy("op")
        .agg(F.sum(cpu).alias("cpu"), F.sum(wall).alias("wall"))
        .withColumn(
            "usage_pct",
            F.try_divide(F.col("cpu").cast("double") * 100, F.col("wall").cast("double")),
        )
    )


def running_max(log: DataFrame, every: int, parts: int | None = None) -> DataFrame:
    """Running count and longest time of each worker at every ``every``-th operation.

    Operations up to a report are whole groups of ``every``, so the log is
    reduced to these groups on the map side and only they are ordered.
    """
    group = div(F.col("seq") - 1, every) + 1
    groups = log.withColumn("_g", group).groupBy("worker", "_g").agg(
        _rows().alias("_n"),
        F.max("elapsed").alias("_m"),
        F.max(F.col("seq") == F.col("_g") * every).alias("_full"),
    )
    aggs = {"calls": ("sum", "_n"), "max_elapsed": ("max", "_m")}
    return (
        running(groups, ["worker"], "_g", aggs, parts=parts)
        .where("_full")
        .select("worker", (F.col("_g") * every).alias("seq"), "calls", "max_elapsed")
    )


def milestones(log: DataFrame) -> DataFrame:
    """Rows at seq 1, 10, 100, … of each worker."""
    powers = [10**i for i in range(19)]
    return log.where(F.col("seq").isin(powers))


def running_total(log: DataFrame, parts: int | None = None) -> DataFrame:
    """Items created before and after each iteration, over all workers."""
    per_iteration = log.groupBy("seq").agg(
        F.sum("items").alias("items"), F.sum("elapsed").alias("elapsed")
    )
    before = {"items_before": ("sum", "items")}
    return running(per_iteration, [], "seq", before, exclusive=True, parts=parts).withColumn(
        "items_after", F.col("items_before") + F.col("items")
    )


def id_gap(ids: DataFrame, col: str, start: int | None = None, parts: int | None = None) -> DataFrame:
    """Difference of every id to the one before it; ``start`` precedes the first.

    The id before is the largest smaller one, which is a running maximum.
    """
    prev = running(ids.select(col), [], col, {"prev": ("max", col)}, True, parts)
    before = F.col("prev") if start is None else F.coalesce("prev", F.lit(start).cast("bigint"))
    return prev.select(col, (F.col(col) - before).alias("gap"))


def mask_bucket(ids: DataFrame, col: str, size: int = 16) -> DataFrame:
    """Ids grouped into aligned blocks of ``size`` (a power of two)."""
    first = F.col(col).bitwiseAND(F.lit(-size).cast("bigint"))
    return (
        ids.groupBy(first.alias("block_start"))
        .agg(_rows().alias("n"), F.min(col).alias("min_id"), F.max(col).alias("max_id"))
        .withColumn("next_start", F.col("block_start") + size)
    )
