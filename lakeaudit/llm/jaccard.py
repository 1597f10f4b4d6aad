"""Near-duplicates by an n-gram Jaccard join with Bayesian candidate pruning.

1. Documents of equal shingle sets form one class; one of them stands for it.
2. Bands of MinHash values put classes into buckets. Buckets with the same members
   are one unit, large buckets are cut into blocks and pairs of blocks.
3. In a unit the pairs whose first common band is the unit's are compared, sixteen
   MinHash values at a time. A pair is dropped when the posterior probability that
   its similarity reaches the threshold is below ``TOLERANCE``.
4. Shingle sets are fetched for what is left only, and every such pair is verified.

No pair is ever a row: a unit gives each member its number of links and one edge to
the smallest class it is tied to there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import (
    SHINGLE_WORDS, SIMILARITY, distinct_sets, list_column, lists, maybe_in, mix, shingles, small_batches, stored, word_hashes,
)
from lakeaudit.llm.components import components

#: MinHash values of a document; a band is BAND of them. At similarity 0.8 a pair has
#: no common band with probability 0.00006, at 0.9 with less than 10^-10.
BAND = 6
BANDS = 32
STEP = 16
TOLERANCE = 1e-6
#: Classes in a block of a large bucket.
BLOCK = 512
_BATCH_WORDS = 400_000
_A = mix(np.arange(1, BAND * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, BAND * BANDS + 1001, dtype=np.uint64))


def _sets(n: int):
    """(doc_id, f1, f2, set) of each row with words: a 128-bit name of its shingle set, and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in small_batches(iter([batch]), "words", _BATCH_WORDS):
                values, counts = distinct_sets(*shingles(*lists(part.column("words")), n))
                some = counts > 0
                part = part.filter(pa.array(some))
                counts = counts[some]
                if len(counts):
                    starts = np.cumsum(counts) - counts
                    f1 = np.add.reduceat(mix(values ^ np.uint64(0x51)), starts)
                    f2 = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0xA7)), starts)
                    yield part, values, counts, f1, f2

    return run


def _signatures(n: int):
    sets = _sets(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, counts, f1, f2 in sets(batches):
            starts = np.cumsum(counts) - counts
            sig = np.empty((len(counts), BAND * BANDS), "<u2")
            for k in range(BAND * BANDS):
                low = np.minimum.reduceat(values * _A[k] + _B[k], starts)
                sig[:, k] = (mix(low) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([r.tobytes() for r in sig])],
                ["doc_id", "f1", "f2", "sig"],
            )

    return run


def _members(n: int):
    sets = _sets(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, counts, f1, _ in sets(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(f1.view(np.int64)), list_column(values.view(np.int64), counts, pa.int64())], ["rep", "set"]
            )

    return run


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the matches below which a pair is dropped.

    With a uniform prior the similarity after m of n matches has a Beta(m + 1, n - m + 1)
    distribution; it reaches t with the probability that n + 1 trials of chance t
    succeed at most m times.
    """
    out = {}
    for n in range(STEP, BAND * BANDS + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict, pa.Table]]:
    """The runs of equal keys in rows sorted by them; a run may span batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(rest)
                rest = []
            last = key
            rest.append(batch.slice(a, b - a))
    if rest:
        yield last, pa.Table.from_batches(rest)


def _candidates(threshold: float, tolerance: float):
    """For each unit and class with partners left: the partners after it in the unit."""
    bounds = least_matches(threshold, tolerance)

    def pairs(sig: np.ndarray, band: int, block: np.ndarray, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
        bands = np.ascontiguousarray(sig).view(np.dtype((np.void, 2 * BAND))).reshape(len(sig), BANDS)
        codes = [np.unique(bands[:, b], return_inverse=True)[1] for b in range(band + 1)]
        left, right = (np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())) if crossed else (np.arange(len(sig)),) * 2
        all_a, all_b = [], []
        for lo in range(0, len(left), 128):
            rows = left[lo : lo + 128]
            open_ = codes[band][rows][:, None] == codes[band][right][None, :]
            if not crossed:
                open_ &= rows[:, None] < right[None, :]
            for b in range(band):
                open_ &= codes[b][rows][:, None] != codes[b][right][None, :]
            i, j = np.nonzero(open_)
            a, b = rows[i], right[j]
            matches = np.zeros(len(a), np.int64)
            for n, least in bounds.items():
                matches += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(axis=1)
                keep = matches >= least
                a, b, matches = a[keep], b[keep], matches[keep]
            all_a.append(a)
            all_b.append(b)
        return np.concatenate(all_a), np.concatenate(all_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), unit in _units(batches, ["key", "i", "j"]):
            reps = unit.column("rep").to_numpy()
            if len(reps) < 2:
                continue
            sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), "<u2").reshape(len(reps), -1)
            a, b = pairs(sig, unit.column("band")[0].as_py(), unit.column("block").to_numpy(), i != j)
            if not len(a):
                continue
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            used = np.union1d(a, b)
            counts = np.bincount(a, minlength=len(reps))[used]
            m = len(used)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m, key)), pa.array(np.full(m, i, np.int32)), pa.array(np.full(m, j, np.int32)),
                    pa.array(reps[used]), unit.column("copies").combine_chunks().take(pa.array(used)),
                    list_column(reps[b], counts, pa.int64()),
                ],
                ["key", "i", "j", "rep", "copies", "partners"],
            )

    return run


def _verified(threshold: float):
    """For each unit and class: its links there, counted in documents, and the smallest class it is tied to."""

    def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) <= 8 * len(sets):
            return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
        flat, code = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        often = np.bincount(code, minlength=len(flat)) > 1
        column = np.cumsum(often) - 1
        row, code = row[often[code]], column[code[often[code]]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        total = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(often.sum()), 2_048):
            at = slice(*np.searchsorted(code, (lo, lo + 2_048)))
            ones = np.zeros((len(sets), 2_048), np.float32)
            ones[row[at], code[at] - lo] = 1
            total += ones @ ones.T
        return total[a, b].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in _units(batches, ["key", "i", "j"]):
            reps, first = np.unique(unit.column("rep").to_numpy(), return_index=True)
            unit = unit.take(pa.array(first))
            sets = [np.asarray(s.values, np.int64) for s in unit.column("set")]
            partners = [np.asarray(p.values, np.int64) for p in unit.column("partners")]
            a = np.repeat(np.arange(len(reps)), [len(p) for p in partners])
            b = np.searchsorted(reps, np.concatenate(partners))
            size = np.array([len(s) for s in sets])
            common = shared(sets, a, b)
            tied = common >= threshold * (size[a] + size[b] - common) - 1e-9
            a, b = a[tied], b[tied]
            copies = unit.column("copies").to_numpy()
            links = np.bincount(a, copies[b], len(reps)) + np.bincount(b, copies[a], len(reps))
            root = np.arange(len(reps))
            while True:
                was = root.copy()
                np.minimum.at(root, a, was[b])
                np.minimum.at(root, b, was[a])
                root = root[root]
                if (root == was).all():
                    break
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps[some]), pa.array(links[some].astype(np.int64)), pa.array(reps[root][some])], ["rep", "links", "tied"]
            )

    return run


def ngram_jaccard_join(
    docs: DataFrame, threshold: float = SIMILARITY, n: int = SHINGLE_WORDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """doc_id, class_id and n_links of each document of ``docs`` (doc_id, text).

    Two documents are linked when the Jaccard similarity of their sets of ``n``-word
    shingles is at least ``threshold``. ``n_links`` counts the other rows that a row is
    linked to, exact copies included; ``class_id`` is the smallest id reached over links.
    Documents of fewer than ``n`` words have one shingle; documents without words have
    none and no links, as have null texts. Rows of null doc_id take no part. Repeated
    rows count as copies and come out as often as they go in. Further columns are not
    read; an empty table gives no rows.
    """
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = own.select("doc_id", word_hashes(F.col("text")).alias("words"))
    rows = stored(hashed.mapInArrow(_signatures(n), "doc_id long, f1 long, f2 long, sig binary"), "jaccard-rows")
    # f1 alone names a class from here on; f2 keeps two sets that share f1 apart
    classes = rows.groupBy("f1", "f2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min_by("sig", "doc_id").alias("sig"))
    classes = stored(classes.withColumn("rep", F.col("f1")).drop("f1", "f2"), "jaccard-classes")

    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * (2 * BAND) + 1, F.lit(2 * BAND))),
    )
    bands = classes.select("rep", F.posexplode(band).alias("band", "key")).repartition("key")
    buckets = bands.groupBy("key").agg(
        F.min("band").alias("band"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
    )
    units = buckets.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("u")).select("n", "u.band", "u.key")
    members = bands.select("rep", "key").join(units, "key").join(classes.select("rep", "copies", "sig"), "rep")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = members.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), blocks).cast("int"))
    members = members.select("*", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("other"))
    members = members.select(
        "key", "band", "rep", "copies", "sig", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    unit = ["key", "i", "j"]
    left = members.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(
        _candidates(threshold, tolerance), "key long, i int, j int, rep long, copies long, partners array<long>"
    )
    left = stored(left, "jaccard-candidates")

    needed = left.select("rep").distinct().join(classes.select("rep", "first"), "rep").select(F.xxhash64("first").alias("h"))
    wanted = maybe_in(own, F.xxhash64("doc_id"), needed, "h").select(word_hashes(F.col("text")).alias("words"))
    sets = wanted.mapInArrow(_members(n), "rep long, set array<long>")
    verified = (
        left.join(sets, "rep").repartition(*unit).sortWithinPartitions(*unit)
        .mapInArrow(_verified(threshold), "rep long, links long, tied long")
    )
    verified = stored(verified, "jaccard-links")

    roots = components(verified.select(F.col("rep").alias("a"), F.col("tied").alias("b")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("rep", "copies", "first").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    known = known.select("rep", "first", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = known.join(known.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("rep", "class_id", "n_links")
    with_words = rows.select("doc_id", F.col("f1").alias("rep")).join(named, "rep").select("doc_id", "class_id", "n_links")
    no_words = own.where(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", "")) == 0)
    return with_words.unionByName(no_words.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
