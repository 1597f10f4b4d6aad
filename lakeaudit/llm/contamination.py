"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set, by powers of two. For the
partition of sizes [s, 2s) a document is cut into windows of 4s shingles, one every
2s, so that an item's place lies whole in a window of its own order of size and a
short item is not lost in a long text. Items and windows are sketched by one
permutation: hashes fall into a fixed number of bins, the least of each bin is kept.
Partitions of small items keep every value, as there a bin's least value may hide the
few an item has. A document and an item with a common value in a window are a
candidate; only candidates' texts are read again, and exact shingle containment over
the whole text decides.

A window's value can only match if it is a value of an item of that partition. So
only windows around such shingles are sketched, which gives the same values.

What sketches may miss: nothing below 32 shingles. Above, a text that holds 0.8 of an
item has at least 26 of its shingles, and for the largest items about a fifth of the
window's 256 least values are the item's; that no such value is common has a
probability far below 10^-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import (
    SHINGLE_WORDS, SIMILARITY, bit_array, distinct_sets, in_bits, list_column, lists, maybe_in, mix, shingles, small_batches, stored, word_hashes,
)

#: Bins of a sketch; partitions of items below 2^5 shingles keep every value instead.
BINS = 256
WHOLE_CLASSES = 5
#: 64-bit words of each of the two bit sets that tasks hold.
BIT_WORDS = 1 << 18
_BATCH_WORDS = 1_000_000


def _window(size_class: int) -> int:
    return 4 << size_class


def _keyed(hashes: np.ndarray, size_class: int) -> np.ndarray:
    """Values of a partition, so that those of others don't match."""
    return mix(hashes ^ mix(np.array([size_class + 1], np.uint64)))


def _least(window: np.ndarray) -> np.ndarray:
    """The least hash of each bin; the greatest number where a bin is empty."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, (window & np.uint64(BINS - 1)).astype(np.int64), window)
    return out


def _sketched(own: np.ndarray, at: np.ndarray, size_class: int) -> np.ndarray:
    """Which places ``at`` of a document's shingles are a value of a window that holds them."""
    if size_class < WHOLE_CLASSES:
        return np.ones(len(at), bool)
    step, out = _window(size_class) // 2, np.zeros(len(at), bool)
    for back in (0, 1):
        first = np.maximum(at // step - back, 0)
        for w in np.unique(first):
            inside = np.flatnonzero(first == w)
            least = _least(own[w * step : (w + 2) * step])
            values = own[at[inside]]
            out[inside] |= least[(values & np.uint64(BINS - 1)).astype(np.int64)] == values
    return out


def _item_sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, counts = distinct_sets(*shingles(*lists(batch.column("words")), n))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)))
            ends = np.cumsum(counts)
            names = (sums[ends] - sums[ends - counts]).view(np.int64)
            keys, classes = [np.zeros(0, np.uint64)], []
            for end, count in zip(ends, counts):
                own, c = values[end - count : end], max(int(count).bit_length() - 1, 0)
                keys.append(_keyed(own if c < WHOLE_CLASSES else np.intersect1d(own, _least(own)), c))
                classes.append(c)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"), pa.array(names, pa.int64()), pa.array(classes, pa.int32()),
                    list_column(values.view(np.int64), counts, pa.int64()),
                    list_column(np.concatenate(keys).view(np.int64), np.array([len(k) for k in keys[1:]], int), pa.int64()),
                ],
                ["item_id", "name", "size_class", "set", "keys"],
            )

    return run


def _values(n: int, bits, classes: list[int] | None):
    """(doc_id, text_hash, value): a text's sketch values that an item may have; its shingles that one may have without ``classes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            for part in small_batches(iter([batch]), "words", _BATCH_WORDS):
                own, counts = shingles(*lists(part.column("words")), n)
                starts = np.cumsum(counts) - counts
                doc = np.repeat(np.arange(len(counts)), counts)
                found = []
                for c in [None] if classes is None else classes:
                    keyed = own if c is None else _keyed(own, c)
                    near = np.flatnonzero(in_bits(known, keyed))
                    if c is not None and c >= WHOLE_CLASSES:
                        parts = np.split(near, np.flatnonzero(np.diff(doc[near])) + 1) if len(near) else []
                        parts = [x[_sketched(own[starts[d := doc[x[0]]] : starts[d] + counts[d]], x - starts[d], c)] for x in parts]
                        near = np.concatenate(parts) if parts else near
                    found.append((doc[near], keyed[near]))
                docs, values = (np.concatenate(x) for x in zip(*found)) if found else (doc[:0], own[:0])
                if len(docs):
                    rows = np.unique(np.rec.fromarrays((docs, values.view(np.int64))))
                    take = pa.array(rows.f0)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(rows.f1)], ["doc_id", "text_hash", "value"]
                    )

    return run


def contaminated(docs: DataFrame, items: DataFrame, least: float = SIMILARITY, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, item_id, n_items, n_shared, n_shingles, containment of documents that hold an item.

    ``docs`` (doc_id, text) hold an item of ``items`` (item_id, text) when at least the
    share ``least`` of the item's distinct ``n``-word shingles occur in the document's
    whole text. Items of equal shingle sets are one: ``item_id`` is the smallest id,
    ``n_items`` their number. An item of fewer than ``n`` words has one shingle of all its
    words, which only a document of just these words shares; items without words are in
    no document, documents without words hold none. Rows of null ids take no part,
    repeated rows give their result once; texts that share an id are judged each on its own,
    and the one that shares most counts for the id. Further columns are not read, empty
    tables give no rows.
    """
    spark = docs.sparkSession
    own = items.where(F.col("item_id").isNotNull()).select("item_id", word_hashes(F.col("text").cast("string")).alias("words"))
    kind = items.schema["item_id"].dataType.simpleString()
    own = own.mapInArrow(_item_sketches(n), f"item_id {kind}, name long, size_class int, set array<long>, keys array<long>")
    own = own.where(F.size("set") > 0).groupBy("name", "size_class", "set", "keys").agg(
        F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items")
    )
    own = stored(own, "contamination-items")
    sketches = own.select("item_id", F.explode("keys").alias("value"))
    sets = own.select("item_id", "n_items", F.size("set").alias("n_shingles"), F.explode("set").alias("value"))
    classes = sorted(r[0] for r in own.select("size_class").distinct().collect())  # one for each power of two
    key_bits = spark.sparkContext.broadcast(bit_array(sketches, "value", BIT_WORDS))
    set_bits = spark.sparkContext.broadcast(bit_array(sets, "value", BIT_WORDS))

    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, value long"
    hashed = lambda df: df.select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("words"))
    found = stored(hashed(texts).mapInArrow(_values(n, key_bits, classes), kind), "contamination-sketches")
    near = stored(found.distinct().join(sketches, "value").select("doc_id", "text_hash", "item_id").distinct(), "contamination-candidates")

    again = maybe_in(texts, F.xxhash64("doc_id"), near.select(F.xxhash64("doc_id").alias("k")), "k")
    shared = hashed(again).mapInArrow(_values(n, set_bits, None), kind).distinct().join(sets, "value")
    shared = shared.groupBy("doc_id", "text_hash", "item_id").agg(
        F.count("*").alias("n_shared"), F.first("n_items").alias("n_items"), F.first("n_shingles").cast("long").alias("n_shingles")
    )
    share = F.col("n_shared") / F.col("n_shingles")
    shared = shared.where(share >= least - 1e-12).join(near, ["doc_id", "text_hash", "item_id"], "left_semi")
    shared = shared.groupBy("doc_id", "item_id", "n_items", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return shared.select("doc_id", "item_id", "n_items", "n_shared", "n_shingles", share.alias("containment"))
