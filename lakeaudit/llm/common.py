"""What the operators share: reading and storing tables, word hashes, shingles, bit filters."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.session import new_path

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def tidy(run: Callable) -> Callable:
    """A task's function that gives free memory back at its end: Python workers outlive their tasks and share an executor's memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only this C library has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cut lineage, one computation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made and ended in this block go when they end, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased letter and digit runs of a text, in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column; a null list is empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def shingles(words: np.ndarray, lengths: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each document, in order, and their number.

    A document of one to ``n - 1`` words has one shingle, of all its words; an
    empty document has none.
    """
    words = words.view(np.uint64) if words.dtype == np.int64 else words.astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    prime = np.uint64(0x9E3779B97F4A7C15)
    run = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for j in range(n):
        run = run * prime + words[j : len(words) - n + 1 + j]
    out_starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    long = np.flatnonzero(lengths >= n)
    if len(long):
        at = np.repeat(starts[long] - (np.cumsum(counts[long]) - counts[long]), counts[long]) + np.arange(counts[long].sum())
        to = np.repeat(out_starts[long] - (np.cumsum(counts[long]) - counts[long]), counts[long]) + np.arange(counts[long].sum())
        out[to] = run[at]
    for d in np.flatnonzero((lengths > 0) & (lengths < n)):
        h = np.uint64(lengths[d])
        for w in words[starts[d] : ends[d]]:
            h = (np.array([h]) * prime + w)[0]
        out[out_starts[d]] = h
    return mix(out), counts


def distinct_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document and their number."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], np.bincount(doc[keep], minlength=len(counts)).astype(np.int64)


def list_column(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a list or text column holds about ``most`` values in each."""
    for batch in batches:
        size = np.asarray(pa.compute.fill_null(
            batch.column(column).value_lengths() if pa.types.is_list(batch.schema.field(column).type)
            else pa.compute.binary_length(batch.column(column)), 0))
        group = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


BIT_WORDS = 1 << 17


def bit_words(keys: DataFrame, column: str, words: int = BIT_WORDS) -> DataFrame:
    """A bit set of the 64-bit hashes in ``column``: at most ``words`` rows, whatever the input."""
    spot = F.pmod(F.col(column), F.lit(words * 64))
    return (
        keys.where(F.col(column).isNotNull())
        .select(spot.alias("spot"))
        .groupBy(F.shiftright("spot", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    )


def bit_array(keys: DataFrame, column: str, words: int = BIT_WORDS) -> np.ndarray:
    """``bit_words`` as one array of a fixed size, for use in tasks."""
    rows = bit_words(keys, column, words).toArrow()
    out = np.zeros(words, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def in_bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in the set; the size must be a power of two."""
    spot = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def parted(df: DataFrame, hashed: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose hash may be among ``keys``, and the rows that are certainly not: only the first need a shuffle."""
    bits = F.broadcast(bit_words(keys, column))
    names = [F.col(f"`{n}`") for n in df.columns]
    rows = df.select(F.struct(*names).alias("row"), F.pmod(hashed, F.lit(BIT_WORDS * 64)).alias("spot"))
    rows = rows.join(bits, F.shiftright("spot", 6).cast("int") == F.col("word"), "left")
    maybe = F.expr("coalesce(shiftright(bits, cast(spot & 63 as int)) & 1, 0) = 1")
    return rows.where(maybe).select("row.*"), rows.where(~maybe).select("row.*")


def maybe_in(df: DataFrame, hashed: Column, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose hash may be among ``keys``: a cheap cut before a shuffled join.

    The broadcast bit set has at most ``BIT_WORDS`` rows of 16 bytes (2 MB).
    """
    return parted(df, hashed, keys, column)[0]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``ids`` (doc_id); rows of null id stay."""
    maybe, rest = parted(docs, F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id").alias("k")), "k")
    return rest.unionByName(maybe.join(ids.select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns]))
