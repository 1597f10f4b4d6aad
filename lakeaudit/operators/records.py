"""Fixed-width records: (file, pos, value), where value should equal pos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeaudit.operators.ordered import block_totals, from_blocks, in_blocks


def from_end(records: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with ``_block``, and per block of a cut file how many records the blocks behind it have.

    Blocks are ranges of positions of one file; small files have none.
    """
    cut = in_blocks(records, ["file"], "pos", parts)
    counts = cut.where("_block is not null").groupBy("file", "_block").agg(F.count("*").alias("_n"))
    behind = W.partitionBy("file").orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    return cut, counts.select("file", "_block", F.coalesce(F.sum("_n").over(behind), F.lit(0)).alias("_behind"))


def tail_n(records: DataFrame, n: int, parts: int | None = None) -> DataFrame:
    """The last ``n`` records of each file, with their rank from the end.

    As a reader seeks back from the end of a file, only the blocks that can hold one of its last
    ``n`` records are ordered: those with fewer than ``n`` records behind them, by
    counts that are combined before the shuffle. No task orders a whole large file.
    """
    cut, behind = from_end(records, parts)
    rows = from_blocks(cut, ["file"], behind).withColumn("_behind", F.coalesce("_behind", F.lit(0)))
    w = W.partitionBy("file", "_block").orderBy(F.desc("pos"))
    rows = rows.where(F.col("_behind") < n).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    rows = rows.withColumn("from_end", (F.col("_rank") + F.col("_behind")).cast("bigint")).where(F.col("from_end") <= n)
    return rows.drop("_block", "_behind", "_rank")


def record_verify(records: DataFrame) -> DataFrame:
    """Records whose stored value is not their own position."""
    return records.where(F.col("value") != F.col("pos"))


def in_sample(one_in: int, seed: int = 0):
    """Whether a record is in a repeatable sample, by the MD5 of seed, file and position, which any engine can compute."""
    name = F.md5(F.concat_ws("/", F.lit(seed), F.col("file"), F.col("pos")).cast("binary"))
    return F.conv(F.substring(name, 1, 8), 16, 10).cast("bigint") % one_in == 0


def sampled(records: DataFrame, one_in: int, seed: int = 0) -> DataFrame:
    """A repeatable sample, so a retry agrees."""
    return records.where(in_sample(one_in, seed))


def verified(records: DataFrame, n: int, one_in: int, parts: int | None = None) -> DataFrame:
    """Every record that fails, and whether the checks of the last ``n`` records of a file or of the sample would see it.

    All records are read once to find those that fail; what lies behind a failing one is
    counted by blocks, and inside a block of a cut file, or a small file, by a window over it.
    """
    cut, behind = from_end(records, parts)
    rows = from_blocks(cut, ["file"], behind)
    w = W.partitionBy("file", "_block").orderBy(F.desc("pos"))
    rows = rows.withColumn("_rank", F.row_number().over(w) + F.coalesce("_behind", F.lit(0)))
    return record_verify(rows).select(
        "file", "pos", "value", (F.col("_rank") <= n).alias("in_tail"), in_sample(one_in).alias("in_sample")
    )
