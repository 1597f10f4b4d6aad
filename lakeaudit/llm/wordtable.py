"""BPE encoding and decoding over a table of distinct words.

Words (pieces that encode on their own) are counted in Spark and each distinct one
is encoded once. Ids come back to a text's word positions: those of the most frequent
words in place, from a broadcast table of words and ids of bounded size; those of all
others by shuffles, in which the places of a word meet, take its ids and are joined
with their texts again.
Decoding joins ids with the vocabulary's pieces, a table as large as the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import shuffles_freed, small_batches, tidy
from lakeaudit.llm.pieces import added_tokens, coded_texts, encode_flat, spread, tokenizer

#: The broadcast part: so many words, none longer than so many characters.
COMMON_WORDS = 500_000
COMMON_LENGTH = 48
#: Longer words are dealt over so many tasks each, so each of them is encoded at most so many times.
LONG_PARTS = 64
_BATCH_BYTES = 8 << 20
_DECODED_BYTES = 2_000_000


def _counted_words(added: list[str]):
    """(word, n) of the words of each batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "text", _BATCH_BYTES):
                words, at, _ = coded_texts(part.column("text"), added)
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)).astype(np.int64))], ["word", "n"])

    return run


def _width(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 65_536 else "<u4"


def _ids_of(path: str, words: pa.Array, width: str = "<u4") -> pa.Array:
    flat, counts = encode_flat(path, words.to_pylist())
    flat = flat.astype(width)
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32) * np.int32(flat.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])


def _encoded_words(path: str):
    """(word, n, ids as little-endian 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _ids_of(path, batch.column("word"))], ["word", "n", "ids"])

    return run


def _encoded_places(path: str):
    """(doc_id, h, code): place and ids of a word as one byte string, in whose order places stand; a batch's equal words are encoded once."""
    width = _width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").dictionary_encode()
            ids = _ids_of(path, words.dictionary, width).take(words.indices)
            at = batch.column("at").to_numpy().astype(">u4").tobytes()
            at = pa.Array.from_buffers(pa.binary(4), batch.num_rows, [None, pa.py_buffer(at)]).cast(pa.binary())
            code = pc.binary_join_element_wise(at, ids, pa.scalar(b"", pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), code], ["doc_id", "h", "code"])

    return run


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """word, n of every distinct word of ``docs`` (text)."""
    words = docs.select("text").mapInArrow(tidy(_counted_words(added_tokens(path))), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def _common(counts: DataFrame, path: str, words: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The most frequent words, their ids one after the other, and the number of each word's."""
    most = counts.where(F.length("word") <= COMMON_LENGTH).orderBy(F.desc("n"), "word").limit(words)
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = most.select("word", "n").repartition(tasks, "word").mapInArrow(tidy(_encoded_words(path)), "word string, n long, ids binary")
    # the most frequent first: a text's numbers of words are then small and compress well
    rows = rows.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    ids = rows.column("ids").combine_chunks()
    sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return rows.column("word").combine_chunks().cast(pa.string()), np.frombuffer(b"".join(ids.to_pylist()), "<u4"), sizes


def _joined(values: pa.Array, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The byte strings number ``at`` of ``values`` one after the other, and where each begins and the last one ends."""
    if not len(at):
        return memoryview(b""), np.zeros(1, np.int64)
    taken = values.take(pa.array(at)).cast(pa.large_binary())
    return memoryview(taken.buffers()[2] or b""), np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1]


def _looked_up(part: pa.RecordBatch, common, added: list[str]):
    """Place in the common words of each piece, -1 for others; pieces, their numbers, pieces a row."""
    words, at, lengths = coded_texts(part.column("text"), added)
    known = pc.fill_null(pc.index_in(words.cast(pa.string()), common[0]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return known[at] if len(at) else at, words, at, lengths


def _others(common, added: list[str]):
    """(doc_id, h, at, word) of every piece that is no common word; ``at`` counts the row's other pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "text", _BATCH_BYTES):
                place, words, at, lengths = _looked_up(part, common.value, added)
                row = np.repeat(np.arange(len(lengths)), lengths)[place < 0]
                if len(row):
                    counts = np.bincount(row, minlength=len(lengths))
                    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(take), part.column("h").take(take), pa.array(number.astype(np.int32)), words.take(pa.array(at[place < 0]))],
                        ["doc_id", "h", "at", "word"],
                    )

    return run


def _packed(pack, values: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """Runs of numbers below 2^24 between ``cuts``, compressed byte by byte: low bytes, middle bytes, high bytes."""
    return [
        pa.array([pack.compress(b[x:y]) for x, y in zip(cuts, cuts[1:])], pa.binary())
        for b in (((values >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16))
    ]


def _in_place(common, added: list[str]):
    """(doc_id, h, common words as ranks, gaps): after how many common words each other piece belongs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in small_batches(iter([batch]), "text", _BATCH_BYTES):
                place, _, _, lengths = _looked_up(part, common.value, added)
                row = np.repeat(np.arange(len(lengths)), lengths)
                own = place >= 0
                have = np.bincount(row[own], minlength=len(lengths))
                cuts = np.concatenate(([0], np.cumsum(have)))
                gaps = (np.cumsum(own) - cuts[row])[~own].astype("<i4")
                others = np.concatenate(([0], np.cumsum(lengths - have)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("h"), *_packed(pack, place[own], cuts),
                        pa.array([pack.compress(np.diff(gaps[a:b], prepend=0).astype("<i4").tobytes()) if b > a else b"" for a, b in zip(others, others[1:])], pa.binary()),
                    ],
                    ["doc_id", "h", "low", "middle", "high", "gaps"],
                )

    return run


def _merged(common, path: str):
    width = _width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        _, flat, sizes = common.value
        for batch in batches:
            out = []
            for *planes, gaps, others in zip(*(batch.column(c).to_pylist() for c in ("low", "middle", "high", "gaps", "others"))):
                low, middle, high = (np.frombuffer(unpack.decompress(p), np.uint8).astype(np.int64) for p in planes)
                ranks = low | middle << 8 | high << 16
                ids = spread(flat, sizes, ranks) if len(ranks) else np.zeros(0, "<u4")
                if others:
                    before = np.cumsum(np.frombuffer(unpack.decompress(gaps), "<i4"))
                    at = np.concatenate(([0], np.cumsum(sizes[ranks])))[before] if len(ranks) else before * 0
                    codes = sorted(others)
                    found = np.frombuffer(b"".join(c[4:] for c in codes), width)
                    ids = np.insert(ids, np.repeat(at, [(len(c) - 4) // found.itemsize for c in codes]), found)
                out.append(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return run


def encode_texts(docs: DataFrame, path: str, common_words: int = COMMON_WORDS) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each whole text of ``docs`` (doc_id, text).

    The ids are those of the tokenizer file at ``path`` (byte-level BPE, readable on
    every executor) without special tokens added; an added token's own string in a
    text becomes its id. A null or empty text has no ids. Repeated rows and null ids
    stay; further columns are not read; an empty table gives no rows.
    """
    added = added_tokens(path)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    with shuffles_freed(docs.sparkSession):
        table = _common(word_counts(own, path), path, common_words)
    common = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # id and hash name a row; equal rows have equal pieces, so their common name does no harm
    rows = own.select("doc_id", F.xxhash64("text").alias("h"), "text")
    others = rows.mapInArrow(tidy(_others(common, added)), f"doc_id {kind}, h long, at int, word string")
    # equal words meet in one task, one after the other; words too long to be common may be in most texts, so they are dealt
    deal = F.when(F.length("word") > COMMON_LENGTH, F.pmod("h", F.lit(LONG_PARTS))).otherwise(F.lit(0))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = others.repartition(tasks, "word", deal).sortWithinPartitions("word")
    others = others.mapInArrow(tidy(_encoded_places(path)), f"doc_id {kind}, h long, code binary")
    # a text's words come from many tasks, so combining them before the shuffle would only add to it
    others = others.select(F.col("doc_id").alias("o_id"), F.col("h").alias("o_h"), "code").repartition("o_id", "o_h")
    others = others.groupBy("o_id", "o_h").agg(F.collect_set("code").alias("others"))
    placed = rows.mapInArrow(tidy(_in_place(common, added)), f"doc_id {kind}, h long, low binary, middle binary, high binary, gaps binary")
    found = placed.join(others, (F.col("h") == F.col("o_h")) & F.col("doc_id").eqNullSafe(F.col("o_id")), "left")
    found = found.select("doc_id", "low", "middle", "high", "gaps", "others")
    return found.mapInArrow(tidy(_merged(common, path)), f"doc_id {kind}, ids binary")


def _byte_of() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_table(path: str) -> list[bytes]:
    """The bytes of every id; the table is as large as the vocabulary, whatever the input."""
    own, byte, added = tokenizer(path), _byte_of(), set(added_tokens(path))
    out = []
    for i in range(own.get_vocab_size()):
        name = own.id_to_token(i) or ""
        out.append(name.encode() if name in added else bytes(byte[c] for c in name))
    return out


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids, as ``encode_texts`` gives them; null ids: an empty text.

    Bytes that are no UTF-8 become replacement characters, special tokens their string.
    Ids outside the vocabulary stand for nothing.
    """
    table = encoded.sparkSession.sparkContext.broadcast(piece_table(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = table.value
        values = pa.array(names, pa.binary())
        for batch in batches:
            for part in small_batches(iter([batch]), "ids", _DECODED_BYTES):
                data = [d or b"" for d in part.column("ids").to_pylist()]
                ids = np.frombuffer(b"".join(data), "<u4").astype(np.int64)
                row = np.repeat(np.arange(len(data)), [len(d) // 4 for d in data])
                row, ids = row[ids < len(names)], ids[ids < len(names)]
                joined, places = _joined(values, ids)
                ends = places[np.cumsum(np.bincount(row, minlength=len(data)))]
                out = [str(joined[a:b], "utf-8", "replace") for a, b in zip(np.concatenate(([0], ends)), ends)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names], pa.array(out, pa.string())], [*part.schema.names, "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns, from ids and decoded texts."""
    sha = lambda c: F.sha2(c, 256)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), sha(F.col("ids")).alias("ids_sha256"), sha(F.col("text")).alias("decoded_sha256")
    )
