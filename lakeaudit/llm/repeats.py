"""Removal of long repeated byte strings with suffix arrays, over texts of any number and size.

1. Every string of ``length`` bytes has an anchor: its least-hashed run of ``gram_of``
   bytes, the same wherever the string stands. Strings of one anchor that follow one
   another in a text are a segment. Only segments whose anchor occurs twice matter.
2. Equal segments become one. A segment that occurs twice is repeated as a whole.
3. Different segments of one anchor go to one shard, but for those that agree with no
   other in the half string on either side of it; the shard's suffixes are put in order
   by external induced sorting, where equal strings are neighbours.
   An anchor whose segments may be larger than a shard is hot: its strings are dealt over
   tasks by their hash and counted there, none of its segments have to meet in one task.
   Equal strings have the anchor at the same distance, so a string is compared with those of its
   distance only: first for blocks of ``STEP`` distances, by the bytes that all strings of a
   block hold and by all bytes of a block, then one by one where only the first agree.
4. What is repeated goes back to the places of its segment, places are merged for each
   text and cut out.

Two equal strings always have the same anchor in the same place, so none is missed, and
every place of a string is in one segment only, so a string never matches itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeaudit.llm.common import bit_array, in_bits, list_column, mix, parted, small_batches, stored, tidy
from lakeaudit.llm.induced import IN_MEMORY, suffix_array
from lakeaudit.session import new_path

#: About 40 words, so that a passage of 50 holds such a string; ``op10`` asks for its contract's 400.
LENGTH = 200
#: Bytes of a text batch, of a shard's text (and of the segments of an anchor that may be sorted in it), words of the anchors' bit set.
BATCH = 1 << 20
SHARD = 1 << 22
ANCHOR_BITS = 1 << 19
#: Distances from a hot anchor that are compared at once.
STEP = 16
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_LOW = np.uint64(0xFFFFFFFF)


def gram_of(length: int) -> int:
    """Bytes of the anchors of strings of ``length`` bytes: a power of two, at most two fifths (128 for 400, 64 for 200)."""
    return 1 << (length * 2 // 5).bit_length() - 1


def _segments(column: pa.Array, length: int):
    """Segments of a batch of byte strings: row, start in the row, bytes, the anchor's place in it and hash; and the joined bytes and row starts."""
    data = column.to_pylist()
    sizes = np.array([len(d or b"") for d in data], np.int64)
    joined = np.frombuffer(b"".join(d or b"" for d in data), np.uint8)
    begins = np.cumsum(sizes) - sizes
    size_of_gram = gram_of(length)
    window = length - size_of_gram + 1
    none = np.zeros(0, np.int64)
    if len(joined) < length:
        return none, none, none, none, np.zeros(0, np.uint64), joined, begins
    gram, width = _BYTE[joined], 1
    while width < size_of_gram:
        gram = gram[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + gram[width:]
        width *= 2
    gram = mix(gram)
    keyed = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    blocks = np.full(-(-len(keyed) // window) * window, np.uint64(2**64 - 1))
    blocks[: len(keyed)] = keyed
    blocks = blocks.reshape(-1, window)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    places = len(joined) - length + 1
    anchor = (np.minimum(onward[:places], upto[window - 1 : window - 1 + places]) & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)[:places]
    fits = np.arange(places) + length <= (begins + sizes)[row]
    at = np.flatnonzero(fits)
    if not len(at):
        return none, none, none, none, np.zeros(0, np.uint64), joined, begins
    first = np.ones(len(at), bool)
    first[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    heads = np.flatnonzero(first)
    start = at[heads]
    last = at[np.append(heads[1:], len(at)) - 1]
    return row[start], start - begins[row[start]], last + length - start, anchor[start] - start, gram[anchor[start]], joined, begins


def _anchor_counts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "data", BATCH):
                found, n = np.unique(_segments(part.column("data"), length)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def _places(length: int, bits):
    """Per text and different segment whose anchor may occur twice: where it starts; its bytes once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "data", BATCH):
                row, start, size, inside, anchor, joined, begins = _segments(part.column("data"), length)
                maybe = np.flatnonzero(in_bits(bits.value, anchor)) if len(anchor) else []
                starts: dict = {}
                content: dict = {}
                for i in maybe:
                    lo = begins[row[i]] + start[i]
                    piece = joined[lo : lo + size[i]].tobytes()
                    name = xxhash.xxh3_128_digest(piece)
                    key = (anchor[i], name, inside[i])
                    starts.setdefault((row[i], key), []).append(start[i])
                    content.setdefault(key, piece)
                if starts:
                    keys = [k for _, k in starts]
                    first = {k: i for i, k in reversed(list(enumerate(keys)))}
                    names = np.frombuffer(b"".join(k[1] for k in keys), np.int64).reshape(-1, 2)
                    take = pa.array([r for r, _ in starts])
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(take), part.column("h").take(take),
                            pa.array(np.array([k[0] for k in keys], np.uint64).view(np.int64)),
                            pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()),
                            list_column(np.concatenate([np.array(s, np.int64) for s in starts.values()]), np.array([len(s) for s in starts.values()]), pa.int64()),
                            pa.array([len(content[k]) for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()),
                            pa.array([content[k] if first[k] == i else None for i, k in enumerate(keys)], pa.binary()),
                        ],
                        ["doc_id", "h", "anchor", "n1", "n2", "starts", "size", "inside", "content"],
                    )

    return run


def repeated(contents: list[bytes], length: int, folder: str, most: int) -> list[np.ndarray]:
    """Of each of some byte strings the starts of ``length`` bytes that also start elsewhere in them."""
    text = np.ones(sum(map(len, contents)) + len(contents) + 1, np.int32)
    fits = np.zeros(len(text), bool)
    lo, starts = 0, []
    for c in contents:
        text[lo : lo + len(c)] = np.frombuffer(c, np.uint8).astype(np.int32) + 2
        fits[lo : lo + max(len(c) - length + 1, 0)] = True
        starts.append(lo)
        lo += len(c) + 1
    text[-1] = 0
    order = suffix_array(text, folder, most)
    order = order[fits[order]]
    # neighbours in order that agree in ``length`` bytes, by sums over prefixes
    alike = np.ones(max(len(order) - 1, 0), bool)
    for odd in (0xD1342543DE82EF95, 0xA0761D6478BD642F):
        power = np.cumprod(np.full(len(text), np.uint64(odd)))
        back = np.cumprod(np.full(len(text), np.uint64(pow(odd, -1, 2**64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(np.arange(258, dtype=np.uint64) + np.uint64(odd))[text] * power)))
        value = (sums[order + length] - sums[order]) * back[order]
        alike &= value[1:] == value[:-1]
    flag = np.zeros(len(text), bool)
    flag[order[1:][alike]] = True
    flag[order[:-1][alike]] = True
    return [np.flatnonzero(flag[s : s + len(c)]) for s, c in zip(starts, contents)]


def _shards(length: int, folder: str, most: int, shard: int):
    """(anchor, n1, n2, runs): of the segments of anchors with several, what is repeated, as starts and ends in turn."""

    gram = gram_of(length)
    half = (length - gram) // 2

    def alike(group: list[tuple]) -> list[tuple]:
        """Segments that agree with another one in the half string left or right of the anchor, as every common string does."""
        if len(group) < 2:
            return []
        sides = [
            (at >= half and ("l", piece[at - half : at]), len(piece) >= at + gram + half and ("r", piece[at + gram : at + gram + half]))
            for _, _, _, piece, at in group
        ]
        count = Counter(s for pair in sides for s in pair if s)
        return [g for g, pair in zip(group, sides) if any(s and count[s] > 1 for s in pair)]

    def sorted_out(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated([r[3] for r in rows], length, folder, most)
        runs = []
        for at in found:
            cut = np.flatnonzero(np.diff(at) > length)
            heads, tails = (at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + length) if len(at) else (at, at)
            runs.append(np.stack((heads, tails), axis=1).ravel())
        return pa.RecordBatch.from_arrays(
            [
                *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)],
                list_column(np.concatenate(runs), np.array([len(r) for r in runs]), pa.int64()),
            ],
            ["anchor", "n1", "n2", "runs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group, size = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "n1", "n2", "content", "inside"))):
                if group and row[0] != group[0][0]:
                    group = alike(group)
                    rows += group
                    size += sum(len(g[3]) for g in group)
                    group = []
                    if size >= shard:
                        yield sorted_out(rows)
                        rows, size = [], 0
                group.append(row)
        rows += alike(group)
        if rows:
            yield sorted_out(rows)

    return run


def _digests(found: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _blocks(length: int):
    """Per segment of a hot anchor and block of distances its strings have: the first and last start, hashes of the common and of all bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "content", BATCH):
                rows, first, last, common, whole = [], [], [], [], []
                for row, (piece, at) in enumerate(zip(part.column("content").to_pylist(), part.column("inside").to_pylist())):
                    least = at - len(piece) + length
                    for k in range(least // STEP, at // STEP + 1):
                        near, far = max(least, STEP * k), min(at, STEP * k + STEP - 1)
                        rows.append(row)
                        first.append(at - far)
                        last.append(at - near)
                        common.append(xxhash.xxh3_128_digest(piece[at - STEP * k : at - STEP * k - STEP + 1 + length], k))
                        whole.append(xxhash.xxh3_128_digest(piece[at - far : at - near + length], far << 32 | near))
                if rows:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[part.column(c).take(take) for c in ("anchor", "n1", "n2")],
                            pa.array(first, pa.int32()), pa.array(last, pa.int32()), *_digests(common), *_digests(whole),
                        ],
                        ["anchor", "n1", "n2", "first", "last", "c1", "c2", "w1", "w2"],
                    )

    return run


def _strings(length: int):
    """Every string of the open blocks of a segment: where it starts and its hash with its distance from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "content", BATCH):
                rows, starts, found = [], [], []
                columns = (part.column(c).to_pylist() for c in ("content", "inside", "blocks"))
                for row, (piece, at, blocks) in enumerate(zip(*columns)):
                    for b in blocks:
                        for start in range(b["first"], b["last"] + 1):
                            rows.append(row)
                            starts.append(start)
                            found.append(xxhash.xxh3_128_digest(piece[start : start + length], at - start))
                if rows:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c).take(take) for c in ("anchor", "n1", "n2")], pa.array(starts, pa.int32()), *_digests(found)],
                        ["anchor", "n1", "n2", "start", "s1", "s2"],
                    )

    return run


def _joined_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for blocks in batch.column("blocks").to_pylist():
                own: list[int] = []
                for a, b in sorted((x["first"], x["last"] + length) for x in blocks):
                    if own and a <= own[-1]:
                        own[-1] = max(own[-1], b)
                    else:
                        own += [a, b]
                runs.append(own)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("anchor", "n1", "n2")], pa.array(runs, pa.list_(pa.int64()))], ["anchor", "n1", "n2", "runs"]
            )

    return run


def _of_hot(segments: DataFrame, length: int) -> DataFrame:
    """(anchor, n1, n2, runs) as of ``_shards``, without bringing the segments of an anchor together."""
    name = ["anchor", "n1", "n2"]
    segments = stored(segments, "repeat-hot")
    blocks = segments.mapInArrow(
        tidy(_blocks(length)), "anchor long, n1 long, n2 long, first int, last int, c1 long, c2 long, w1 long, w2 long"
    )
    blocks = stored(blocks, "repeat-blocks")

    def several(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("own").alias("one")).where("n > 1").drop("n")

    # blocks that are equal as a whole are repeated, but others may share some of their strings: one of them stands for all
    keyed = blocks.withColumn("own", F.xxhash64(*name))
    agree = keyed.join(several(keyed, "c1", "c2"), ["c1", "c2"], "left_semi")
    agree = agree.join(several(keyed, "w1", "w2"), ["w1", "w2"], "left").select(
        *name, F.col("one").isNotNull().alias("whole"), F.coalesce(F.col("one") == F.col("own"), F.lit(True)).alias("open"),
        F.struct("first", "last").alias("block"),
    )
    agree = stored(agree, "repeat-agree")
    unsure = agree.where("open").groupBy(*name).agg(F.collect_list("block").alias("blocks"))
    strings = segments.join(unsure, name).mapInArrow(tidy(_strings(length)), "anchor long, n1 long, n2 long, start int, s1 long, s2 long")
    strings = stored(strings, "repeat-strings").withColumn("own", F.xxhash64(*name))
    strings = strings.join(several(strings, "s1", "s2"), ["s1", "s2"], "left_semi")
    strings = strings.select(*name, F.struct(F.col("start").alias("first"), F.col("start").alias("last")).alias("block"))
    found = agree.where("whole").select(*name, "block").unionByName(strings)
    found = found.groupBy(*name).agg(F.collect_list("block").alias("blocks"))
    return found.mapInArrow(tidy(_joined_runs(length)), "anchor long, n1 long, n2 long, runs array<long>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, spans, sizes = [], [], []
        for data, places in zip(batch.column("data").to_pylist(), batch.column("places").to_pylist()):
            runs = np.array(sorted((p["start"], p["stop"]) for p in places or []), np.int64).reshape(-1, 2)
            if len(runs):
                upto = np.maximum.accumulate(runs[:, 1])
                head = np.append(True, runs[1:, 0] > upto[:-1])
                runs = np.stack((runs[head, 0], upto[np.append(head[1:], True)]), axis=1)
            last, out = 0, []
            for a, b in runs.tolist():
                out.append(data[last:a])
                last = b
            kept.append(b"".join([*out, data[last:]]))
            spans.append([{"start": a, "stop": b} for a, b in runs.tolist()])
            sizes.append(len(data))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            ["doc_id", "h", "n_bytes", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, most: int = IN_MEMORY, shard: int = SHARD) -> DataFrame:
    """doc_id, h, n_bytes, spans, kept of every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes. Every byte covered by a string of ``length`` bytes (at least STEP)
    that also starts anywhere else, in the same or another row, is removed; strings are
    judged on the input. ``spans`` are the maximal removed runs, ``kept`` the bytes left
    (which may begin or end inside a character), ``h`` a hash of the text. A null text is
    empty, shorter texts stay whole. Repeated rows are further places, null ids stay;
    further columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.xxhash64(text).alias("h"), text.cast("binary").alias("data"))
    enough = own.where(F.octet_length("data") >= length)
    anchors = enough.select("data").mapInArrow(tidy(_anchor_counts(length)), "anchor long, n long")
    twice = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(bit_array(twice, "anchor", ANCHOR_BITS))
    places = enough.mapInArrow(
        tidy(_places(length, bits)),
        f"doc_id {kind}, h long, anchor long, n1 long, n2 long, starts array<long>, size int, inside int, content binary",
    )
    places = stored(places, "repeat-places")
    bits.destroy()

    name = ["anchor", "n1", "n2"]
    hot = places.groupBy("anchor").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > shard).select("anchor")
    hot = stored(hot, "repeat-anchors")
    some = not hot.isEmpty()
    warm, cool = parted(places, F.col("anchor"), hot, "anchor") if some else (None, places)

    def different(places: DataFrame) -> DataFrame:
        return places.groupBy(*name).agg(F.max("content").alias("content"), F.max("inside").alias("inside"))

    several = different(cool).repartition("anchor").sortWithinPartitions("anchor")
    partly = several.mapInArrow(
        tidy(_shards(length, new_path(spark, "repeat-queues"), most, shard)), "anchor long, n1 long, n2 long, runs array<long>"
    )
    if some:
        partly = partly.unionByName(_of_hot(different(warm), length))
    wholly = places.groupBy(*name).agg(F.sum(F.size("starts")).alias("n"), F.max("size").cast("long").alias("size"))
    wholly = wholly.where("n > 1").select(*name, F.array(F.lit(0).cast("long"), F.col("size")).alias("runs"))
    marks = stored(wholly.unionByName(partly.where(F.size("runs") > 0)), "repeat-marks")

    covered = places.select("doc_id", "h", *name, "starts").join(marks, name)
    ends = F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2))
    # all places of a segment in a text stay in its row
    pairs = lambda at: F.transform(
        ends, lambda i: F.struct((at + F.get("runs", i)).alias("start"), (at + F.get("runs", i + 1)).alias("stop"))
    )
    pairs = F.flatten(F.transform("starts", pairs)).alias("pairs")
    covered = covered.select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), pairs)
    # a set: equal rows have equal places, however many they are
    covered = covered.groupBy("c_id", "c_h").agg(F.flatten(F.collect_set("pairs")).alias("places"))
    covered = stored(covered, "repeat-covered")

    # only texts that may have something to remove are shuffled
    maybe, rest = parted(own, F.xxhash64("doc_id", "h"), covered.select(F.xxhash64("c_id", "c_h").alias("k")), "k")
    none = F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")
    hit = maybe.join(covered, (F.col("h") == F.col("c_h")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    rows = hit.select("doc_id", "h", "data", "places").unionByName(rest.withColumn("places", none))
    return rows.mapInArrow(
        tidy(_cut), f"doc_id {kind}, h long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    )


def digest(removed: DataFrame, *more: Column) -> DataFrame:
    """The contract's columns."""
    return removed.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
        *more,
    )


def outcome(removed: DataFrame) -> DataFrame:
    """The contract's columns, and the bytes and characters left."""
    left = F.octet_length("kept").cast("long").alias("bytes_left")
    return digest(removed, left, F.length(F.col("kept").cast("string")).cast("long").alias("n_chars"))


def as_text(column: str) -> Column:
    """The whole characters of a binary column of UTF-8, without those cut in two.

    Only the bytes behind a cut can be continuations without a start, and only those
    before it starts without an end; both are left out.
    """
    return _text(F.col(column))


@F.pandas_udf(StringType())
def _text(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else bytes(d).decode("utf-8", "ignore"))
