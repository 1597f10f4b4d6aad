"""Running aggregates over ordered rows without one task per key.

A window over a key runs in one task. Here keys are cut where a range partitioning by
(keys, position) would cut them: a sample of fixed size, ordered by keys and position, gives a
border every few rows, so a key has as many borders as its share of the rows asks
for, and most keys have none. Rows between two borders of a key are a block.

All rows are dealt once by (keys, block). Windows run inside blocks, every block of a cut
key gives one row with its totals, and what the blocks before add up to comes back
through a join with these few rows. No key is too large or too small for this; there is
no other way for hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}
#: One row in so many may be in the sample; sampled rows between two borders.
_ONE_IN = 64
_EACH = 8


def _merge(kind: str, here: Column, before: Column) -> Column:
    if kind == "sum":
        return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    return F.greatest(here, before) if kind == "max" else F.least(here, before)


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def _borders(df: DataFrame, keys: list[str], pos: str, parts: int) -> DataFrame:
    """(_c0, _c1, …, _cuts): of every key that is cut its ascending borders, at most ``parts`` in all.

    The sample has at most ``_EACH * parts`` rows, one for each value of a hash, of a fixed share of the rows, combined before
    the shuffle. It depends on the rows alone, so it is the same whenever it is read.
    """
    row = F.struct(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col(pos).alias("_at"))
    name = F.xxhash64(*keys, pos)
    some = df.select(row.alias("_row"), name.alias("_name")).where(F.pmod("_name", F.lit(_ONE_IN)) == 0)
    bin_ = F.pmod(F.xxhash64("_name"), F.lit(_EACH * parts)).alias("_bin")
    sample = some.groupBy(bin_).agg(F.min_by("_row", "_name").alias("_row"))
    own = [f"_c{i}" for i in range(len(keys))]
    # one task orders the sample, whose size does not grow with the rows
    number = F.row_number().over(W.partitionBy("_one").orderBy(*own, "_at"))
    border = sample.repartition(1).select(F.pmod("_bin", F.lit(1)).alias("_one"), "_row.*")
    border = border.select(*own, "_at", number.alias("_number")).where(F.col("_number") % _EACH == 0)
    return border.groupBy(*own).agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))


def in_blocks(df: DataFrame, keys: list[str], pos: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``_block``: the number of its key's borders below ``pos``, NULL for keys that are not cut."""
    parts = _parts(df, parts)
    borders = _borders(df, keys, pos, parts)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(parts.bit_length()))])
    below = F.aggregate(  # binary search
        steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col(pos), at + step).otherwise(at)
    )
    found = df.join(F.broadcast(borders), _same(keys, [f"_c{i}" for i in range(len(keys))]), "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_cuts").isNotNull(), below).alias("_block"))


def block_totals(dealt: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """One row per block of a cut key, of rows dealt by keys and ``_block``; at most twice as many as borders.

    Every column is named, since only then is the exchange the same as that of the rows
    themselves and is made once.
    """
    every = F.first(F.struct(*[F.col(f"`{c}`") for c in dealt.columns]))
    totals = dealt.groupBy(*keys, "_block").agg(*aggs, every.alias("_every"), F.max(F.col("_block").isNotNull()).alias("_cut"))
    return totals.where("_cut and _every is not null").drop("_every", "_cut")


def from_blocks(rows: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``carry`` (keys, _block, …), which has a row for some blocks."""
    own = [f"_k{i}" for i in range(len(keys) + 1)]
    carry = carry.withColumnsRenamed(dict(zip([*keys, "_block"], own)))
    return rows.join(F.broadcast(carry), _same([*keys, "_block"], own), "left").drop(*own)


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    aggs: dict[str, tuple[str, str]],
    exclusive: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Running sum, max or min per key in the order of the column ``pos``.

    ``pos`` must be unique within a key. ``aggs`` maps an output column to
    (``sum`` | ``max`` | ``min``, input column). With ``exclusive`` the current
    row does not count; sums then start at 0, max and min at NULL. No keys means
    one order over the whole table. ``parts`` is the number of borders, as a rule that of
    shuffle partitions.
    """
    names, own = df.columns, keys or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.pmod(F.xxhash64(pos), F.lit(1)))
    dealt = in_blocks(df, own, pos, parts).repartition(*own, "_block")
    ordered = W.partitionBy(*own, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    rows = dealt
    for out, (kind, col) in aggs.items():
        rows = rows.withColumn(f"_here_{out}", _COMBINE[kind](col).over(ordered))
    totals = block_totals(dealt, own, [_COMBINE[kind](col).alias(f"_total_{out}") for out, (kind, col) in aggs.items()])
    before = W.partitionBy(*own).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *own, "_block", *[_COMBINE[kind](f"_total_{out}").over(before).alias(f"_before_{out}") for out, (kind, _) in aggs.items()]
    )
    rows = from_blocks(rows, own, carry)
    merged = [_merge(kind, F.col(f"_here_{out}"), F.col(f"_before_{out}")).alias(out) for out, (kind, _) in aggs.items()]
    return rows.select(*[F.col(f"`{c}`") for c in names], *merged)


def ranked(df: DataFrame, keys: list[str], pos: str, out: str, parts: int | None = None) -> DataFrame:
    """1-based row number per key in the order of ``pos``."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running(one, keys, pos, {out: ("sum", "_one")}, parts=parts).drop("_one")
