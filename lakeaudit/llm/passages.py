"""Removal of repeated passages of words with prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one text; a word goes when a window that
covers it also starts earlier.

1. The suffix of a window is read from the window's anchor, its least-hashed run of
   ``GRAM`` words. That run is the prefix by which suffixes are split into groups;
   windows of one anchor that follow one another are a segment, so neighbours land in
   one group with their words shipped once. Prefixes that occur once lead to no inner
   node: a bit set of fixed size spares most of their segments the shuffle.
2. Equal segments become one, with their earliest place; all their other places go whole.
3. A group of different segments is one subtree, cut at depth ``length``. Its leaves are put in order by
   doubling the depth that is ranked; leaves that agree in ``length`` words hang below
   one deep inner node, and all of them but the earliest are repeats.
   A prefix whose segments exceed a group's memory is lengthened to the whole window: such windows are
   counted one by one, combined before the shuffle, and no task needs all of them.
4. What is repeated goes back to the places of its segment; places are joined for each text.

Equal windows have equal anchors at the same distance, so none is missed, and groups
compare words, not hashes. Segments are named by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import bit_array, in_bits, mix, parted, small_batches, stored, tidy
from lakeaudit.llm.wordlists import joined_words, ranges, word_lists

LENGTH = 20
GRAM = 8
#: Bytes of a text batch, words of a group that is sorted at once, words of the anchors' bit set.
BATCH = 1 << 20
GROUP = 1 << 19
ANCHOR_BITS = 1 << 19
_SPAN = "array<struct<start:int,stop:int>>"


def _hashed(words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word."""
    at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = b"".join(xxhash.xxh3_128_digest(w) for w in words.dictionary.to_pylist())
    both = np.frombuffer(names, np.uint64).reshape(-1, 2)
    return both[at, 0], both[at, 1]


def _sums(words: np.ndarray, odd: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over prefixes from which ``_named`` reads the hash of any run of words."""
    power = np.cumprod(np.full(len(words) + 1, np.uint64(odd)))
    back = np.cumprod(np.full(len(words) + 1, np.uint64(pow(odd, -1, 2**64))))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:-1]))), back


def _named(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix((sums[0][start + size] - sums[0][start]) * sums[1][start] + size.astype(np.uint64))


def _names(hashes: tuple[np.ndarray, np.ndarray], start: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """128-bit names of runs of words."""
    odd = (0xD1342543DE82EF95, 0xA0761D6478BD642F)
    return [pa.array(_named(_sums(h, o), start, size).view(np.int64)) for h, o in zip(hashes, odd)]


def _segments(words: np.ndarray, lengths: np.ndarray, length: int):
    """Segments of hashed words of several texts: text, first word (of all), number of words, the anchor's hash."""
    none = np.zeros(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    places = len(words) - length + 1
    if places < 1:
        return none, none, none, np.zeros(0, np.uint64)
    gram = words
    for j in range(1, GRAM):
        gram = gram[: len(words) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - GRAM + 1 + j]
    gram = mix(gram)
    low = np.uint64(0xFFFFFFFF)
    keyed = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    window = length - GRAM + 1
    least = keyed[:places].copy()
    for j in range(1, window):
        np.minimum(least, keyed[j : places + j], out=least)
    anchor = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)[:places]
    at = np.flatnonzero(np.arange(places) + length <= (begins + lengths)[row])
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    first = np.ones(len(at), bool)
    first[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    heads = np.flatnonzero(first)
    start, last = at[heads], at[np.append(heads[1:], len(at)) - 1]
    return row[start], start, last + length - start, gram[anchor[start]]


def _parts(batches: Iterator[pa.RecordBatch], length: int):
    for batch in batches:
        for part in small_batches(iter([batch]), "text", BATCH):
            words, lengths = word_lists(part.column("text"))
            coded = words.dictionary_encode()
            hashes = _hashed(coded)
            yield part, words, lengths, hashes, _segments(hashes[0], lengths, length)


def _anchor_counts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, segments in _parts(batches, length):
            found, n = np.unique(segments[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def _places(length: int, bits):
    """Per segment whose anchor may occur twice: where it stands; its words once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, lengths, hashes, (row, start, size, anchor) in _parts(batches, length):
            some = in_bits(bits.value, anchor) if len(anchor) else np.zeros(0, bool)
            row, start, size, anchor = row[some], start[some], size[some], anchor[some]
            if not len(row):
                continue
            names = _names(hashes, start, size)
            named = np.stack([n.to_numpy().view(np.uint64) for n in names] + [anchor])
            order = np.lexsort(named)
            new = np.append(True, (named[:, order[1:]] != named[:, order[:-1]]).any(axis=0))
            only = np.sort(order[new])  # one of each name
            texts = joined_words(words.take(pa.array(ranges(start[only], size[only]))), size[only])
            where = np.full(len(row), -1, np.int64)
            where[only] = np.arange(len(only))
            content = texts.take(pa.array(where, mask=where < 0))
            begins = np.cumsum(lengths) - lengths
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(take), part.column("h").take(take), pa.array(anchor.view(np.int64)), *names,
                    pa.array((start - begins[row]).astype(np.int32)), pa.array(size.astype(np.int32)), content,
                ],
                ["doc_id", "h", "anchor", "n1", "n2", "start", "size", "content"],
            )

    return run


def deep_nodes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of some windows of coded words the inner node of depth ``length`` that it hangs below."""
    rank, depth = words.astype(np.int64), 1
    while depth < length:
        step = min(depth, length - depth)  # the last step overlaps the one before
        ahead = np.zeros_like(rank)
        ahead[: max(len(rank) - step, 0)] = rank[step:]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)[1]
        depth += step
    return rank[starts]


def _place_order(table: pa.Table) -> np.ndarray:
    """A number for each row's text that follows the order of (doc_id, h), null ids first."""
    order = pc.sort_indices(table, sort_keys=[("d_id", "ascending"), ("d_h", "ascending")], null_placement="at_start").to_numpy()
    ids = pc.fill_null(table.column("d_id").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[order]
    h = table.column("d_h").to_numpy()[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])) if len(ids) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _subtrees(length: int, group: int):
    """(anchor, n1, n2, runs): of the first place of each segment the runs of words that stand earlier elsewhere."""

    def solved(table: pa.Table) -> pa.RecordBatch:
        words, sizes = word_lists(table.column("content").combine_chunks())
        begins = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        starts, owner = ranges(begins, windows), np.repeat(np.arange(len(sizes)), windows)
        node = deep_nodes(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), starts, length)
        place = (_place_order(table) << np.int64(32))[owner] + table.column("d_start").to_numpy()[owner] + starts - begins[owner]
        order = np.lexsort((place, node))
        later = np.append(False, node[order[1:]] == node[order[:-1]])
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, starts[order[later]], 1)
        np.add.at(change, starts[order[later]] + length, -1)
        own = np.repeat(np.arange(len(sizes)), sizes)
        covered = np.cumsum(change[:-1]) > 0
        edge = np.append(True, own[1:] != own[:-1])
        heads = np.flatnonzero(covered & (edge | ~np.append(False, covered[:-1])))
        tails = np.flatnonzero(covered & (np.append(edge[1:], True) | ~np.append(covered[1:], False))) + 1
        spans = pa.StructArray.from_arrays(
            [pa.array((x - begins[own[heads]]).astype(np.int32)) for x in (heads, tails)], ["start", "stop"]
        )
        counts = np.bincount(own[heads], minlength=len(sizes))
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), spans)
        some = pa.array(np.flatnonzero(counts))
        return pa.RecordBatch.from_arrays(
            [*[table.column(c).combine_chunks().take(some) for c in ("anchor", "n1", "n2")], runs.take(some)], ["anchor", "n1", "n2", "runs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(batch.column("size")).as_py() or 0
            if size >= group:  # all groups but the last are whole
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                whole = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
                if whole:
                    yield from several(table.slice(0, whole))
                    table = table.slice(whole)
                held, size = table.to_batches(), pc.sum(table.column("size")).as_py() or 0
        if held:
            yield from several(pa.Table.from_batches(held))

    def several(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """A segment that is alone in its group repeats nothing; the others go in slices of whole groups."""
        anchor = table.column("anchor").to_numpy()
        again = np.append(False, anchor[1:] == anchor[:-1])
        table = table.take(pa.array(np.flatnonzero(again | np.append(again[1:], False))))
        anchor, upto = table.column("anchor").to_numpy(), np.cumsum(table.column("size").to_numpy().astype(np.int64))
        begin = 0
        while begin < len(anchor):
            end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + group)) + 1
            end = int(np.searchsorted(anchor, anchor[min(end, len(anchor)) - 1], "right"))
            yield solved(table.slice(begin, end - begin))
            begin = end

    return run


def _windows(length: int):
    """Every window of a segment: where it starts and its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "content", BATCH):
                words, sizes = word_lists(part.column("content"))
                begins = np.cumsum(sizes) - sizes
                starts, owner = ranges(begins, sizes - length + 1), np.repeat(np.arange(len(sizes)), sizes - length + 1)
                names = _names(_hashed(words.dictionary_encode()), starts, np.full(len(starts), length))
                take, inside = pa.array(owner), (starts - begins[owner]).astype(np.int32)
                place = part.column("d_start").to_numpy()[owner] + inside
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(take) for c in ("anchor", "n1", "n2", "d_id", "d_h")], pa.array(place.astype(np.int32)), pa.array(inside), *names],
                    ["anchor", "n1", "n2", "d_id", "d_h", "d_start", "inside", "w1", "w2"],
                )

    return run


def _of_hot(segments: DataFrame, kind: str, length: int) -> DataFrame:
    """``_subtrees`` for prefixes that are too large for a group: by the whole window, without bringing segments together."""
    windows = stored(
        segments.mapInArrow(
            tidy(_windows(length)), f"anchor long, n1 long, n2 long, d_id {kind}, d_h long, d_start int, inside int, w1 long, w2 long"
        ),
        "passage-windows",
    )
    place = F.struct("d_id", "d_h", "d_start")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["w1", "w2"]).where(place != F.col("earliest"))
    span = F.struct(F.col("inside").alias("start"), (F.col("inside") + length).alias("stop"))
    return later.groupBy("anchor", "n1", "n2").agg(F.collect_list(span).alias("runs"))  # a segment has few windows


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in small_batches(iter([batch]), "text", BATCH):
            words, lengths = word_lists(part.column("text"))
            begins = np.cumsum(lengths) - lengths
            spans = part.column("places")
            n = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, base = spans.flatten(), np.repeat(begins, n)
            change = np.zeros(len(words) + 1, np.int64)
            if len(flat):
                np.add.at(change, flat.field("start").to_numpy() + base, 1)
                np.add.at(change, flat.field("stop").to_numpy() + base, -1)
            stays = np.cumsum(change[:-1]) == 0
            row = np.repeat(np.arange(len(lengths)), lengths)
            left = np.bincount(row[stays], minlength=len(lengths))
            edge = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
            heads = np.flatnonzero(~stays & (edge | np.append(True, stays[:-1]))) if len(row) else np.zeros(0, np.int64)
            tails = np.flatnonzero(~stays & (np.append(edge[1:], True) | np.append(stays[1:], True))) + 1 if len(row) else heads
            chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
            cut = np.bincount(row[~stays], chars[~stays], minlength=len(lengths)).astype(np.int64)
            out = pa.StructArray.from_arrays([pa.array((x - begins[row[heads]]).astype(np.int64)) for x in (heads, tails)], ["start", "stop"])
            counts = np.concatenate(([0], np.cumsum(np.bincount(row[heads], minlength=len(lengths))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("h"), pa.array(lengths), pa.ListArray.from_arrays(pa.array(counts), out),
                    joined_words(words.filter(pa.array(stays)), left), pc.subtract(pc.utf8_length(part.column("text")).cast(pa.int64()), pa.array(cut)),
                ],
                ["doc_id", "h", "n_words", "spans", "kept", "n_chars"],
            )


def remove_passages(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, h, n_words, spans, kept, n_chars of every row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII blanks (space, tab to carriage return).
    Every word covered by ``length`` (at least GRAM + 1) words that also start earlier, in a text of a smaller
    doc_id or before in the same text, is removed; windows are judged on the input.
    ``spans`` are the removed runs by word number, ``kept`` the other words joined by one space, ``n_chars`` the
    characters of the text without the removed words', ``h`` a hash of the text. A null text has no words, shorter texts stay whole. A null id
    comes before all others; texts of one id come in the order of ``h``, and equal rows
    (same id, same text) are one text, so that they have the same result. Further columns are
    not read; an empty table gives no rows. ``group`` bounds the words one subtree may have.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    enough = own.where(F.octet_length("text") >= 2 * length - 1)
    anchors = enough.select("text").mapInArrow(tidy(_anchor_counts(length)), "anchor long, n long")
    twice = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(bit_array(twice, "anchor", ANCHOR_BITS))
    places = enough.mapInArrow(
        tidy(_places(length, bits)), f"doc_id {kind}, h long, anchor long, n1 long, n2 long, start int, size int, content string"
    )
    places = stored(places, "passage-places")
    bits.destroy()

    name, place = ["anchor", "n1", "n2"], F.struct(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"), F.col("start").alias("d_start"))
    different = places.groupBy(*name).agg(
        F.min(place).alias("place"), F.max("content").alias("content"), F.max("size").alias("size"), F.count("*").alias("n")
    )
    different = stored(different.select(*name, "place.*", "content", "size", "n"), "passage-segments")
    hot = different.groupBy("anchor").agg(F.sum("size").alias("words")).where(F.col("words") > group).select("anchor")
    hot = stored(hot, "passage-hot")
    some = not hot.isEmpty()
    warm, cool = parted(different, F.col("anchor"), hot, "anchor") if some else (None, different)
    cool = cool.select(*name, "d_id", "d_h", "d_start", "content", "size").repartition("anchor").sortWithinPartitions("anchor")
    runs = cool.mapInArrow(tidy(_subtrees(length, group)), f"anchor long, n1 long, n2 long, runs {_SPAN}")
    if some:
        runs = runs.unionByName(_of_hot(warm, kind, length))

    marks = different.select(*name, "d_id", "d_h", "d_start", "n").join(runs, name, "left").where("n > 1 or runs is not null").drop("n")
    covered = places.select("doc_id", "h", *name, "start", "size").join(stored(marks, "passage-marks"), name)
    earliest = F.struct("doc_id", "h", "start").eqNullSafe(F.struct("d_id", "d_h", "d_start"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("stop")))
    covered = covered.select(
        F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), F.col("start").alias("at"),
        F.explode(F.when(earliest, F.col("runs")).otherwise(whole)).alias("run"),
    )
    span = F.struct((F.col("at") + F.col("run.start")).alias("start"), (F.col("at") + F.col("run.stop")).alias("stop"))
    covered = stored(covered.groupBy("c_id", "c_h").agg(F.collect_set(span).alias("places")), "passage-covered")

    # only texts that have something to remove are shuffled
    maybe, rest = parted(own, F.xxhash64("doc_id", "h"), covered.select(F.xxhash64("c_id", "c_h").alias("k")), "k")
    hit = maybe.join(covered, (F.col("h") == F.col("c_h")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    rows = hit.select("doc_id", "h", "text", "places").unionByName(rest.withColumn("places", F.lit(None).cast(_SPAN)))
    return rows.mapInArrow(tidy(_kept), f"doc_id {kind}, h long, n_words long, spans array<struct<start:bigint,stop:bigint>>, kept string, n_chars long")


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns, the number of removed runs and the characters left."""
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return removed.select(
        "doc_id", "n_words", size.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"), "n_chars"
    )
