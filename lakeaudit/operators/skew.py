"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is split. One task can sort and hold this
# many rows with ease, and there are at most rows / HOT_ROWS such keys, so the
# table of hot keys stays small enough to broadcast whatever the input size.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(_hot_key, _parts) for keys above ``hot_rows``; at most rows / hot_rows rows.

    Reads the key column only, and combines on the map side, so a hot key sends
    one row per task through the shuffle.
    """
    counts = df.groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
    return as_hot(counts.where(F.col("_hot_key").isNotNull()), hot_rows)


def as_hot(counts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Same as :func:`hot_keys` from ready (_hot_key, _n) counts."""
    return counts.where(F.col("_n") > hot_rows).select(
        "_hot_key", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")
    )


def salted_join(
    facts: DataFrame,
    dims: DataFrame,
    key: str,
    spread: list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join facts to dims on ``key``, splitting the hot keys of ``facts``.

    A hot key of n rows is dealt over ceil(n / hot_rows) salts by the hash of
    the ``spread`` columns; the matching dim rows are repeated once per salt.
    Cold keys keep salt 0, so dims grow by at most 2 * rows / hot_rows copies of
    a row. ``how`` is inner, left, left_semi or left_anti. ``hot`` may be passed
    when the counts are known already; it may list more keys than needed.
    """
    if hot is None:
        hot = hot_keys(facts, key, hot_rows)
    hot = F.broadcast(hot)
    match = F.col(key) == F.col("_hot_key")
    salt = F.pmod(F.xxhash64(*spread), F.col("_parts").cast("bigint"))
    left = (
        facts.join(hot, match, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int"))
        .drop("_hot_key", "_parts")
    )
    right = (
        dims.join(hot, match, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_hot_key", "_parts")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")
