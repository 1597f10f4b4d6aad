"""Training-order materialisation of token ids.

Texts become sequences of a fixed number of ids. Sequences are numbered without gaps
in the order they are read, and a keyed Feistel permutation with cycle-walking gives
each number its slot: a shuffle of any size that needs no shuffle to compute. Slots
are dealt in ranges, what a task has for a range packed as one row, to tasks that
write shards of fixed-stride records, so slot s is record s mod shard_rows of shard
s div shard_rows, and reading can resume anywhere.

A record is the number of its ids as a little-endian unsigned 32-bit integer, the ids
as unsigned 16-bit integers (32-bit for vocabularies over 65,536), then zeros.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import mix, small_batches, stored
from lakeaudit.llm.pieces import added_tokens, coded_texts, lasting_encoder, spread, tokenizer

SEQUENCE = 256
SHARD_ROWS = 16_384
ROUNDS = 6
BUCKET_SHARDS = 8
_BATCH_BYTES = 8 << 20
# Ids that a task deals out at once, words it remembers, and how hard ids are packed between stages.
_DEALT_BYTES = 24 << 20
_KNOWN_WORDS = 700_000
_LEVEL = 6


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """A permutation of 0 … total - 1, applied to ``numbers``.

    The Feistel network permutes the smallest even-width power of two that holds
    ``total``; what falls outside is permuted again until it falls inside.
    """
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key % 2**64) + np.arange(1, ROUNDS + 1, dtype=np.uint64))
    out = numbers.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[open_] = (left << np.uint64(half)) | right
        open_ = open_[out[open_] >= np.uint64(total)]
    return out.astype(np.int64)


def _item(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 65_536 else "<u4"


def _listed(values: pa.Array, ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)


def _sequences(path: str, length: int, added: list[str]):
    """(task, first, rows, doc_id, part, n, ids): the sequences of some texts in one row, numbered from ``first`` within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, item, pack = lasting_encoder(path, _KNOWN_WORDS), _item(path), zstandard.ZstdCompressor(_LEVEL)
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in small_batches(iter([batch]), "text", _BATCH_BYTES):
                words, at, lengths = coded_texts(some.column("text"), added)
                flat, sizes = encoder.ids(words.to_pylist())
                ids = spread(flat.astype(item), sizes, at)
                ends = np.concatenate(([0], np.cumsum(sizes[at])))[np.cumsum(lengths)]
                begins = np.concatenate(([0], ends[:-1]))
                counts = -(-(ends - begins) // length)
                doc = np.repeat(np.arange(len(counts)), counts)
                if not len(doc):
                    continue
                number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                n = np.minimum(length, ends[doc] - begins[doc] - number * length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task], pa.int32()), pa.array([row], pa.int64()), pa.array([len(doc)], pa.int64()),
                        _listed(some.column("doc_id").take(pa.array(doc)), [len(doc)]), _listed(pa.array(number.astype(np.int32)), [len(doc)]),
                        _listed(pa.array(n.astype(np.int32)), [len(doc)]), pa.array([pack.compress(ids.tobytes())], pa.binary()),
                    ],
                    ["task", "first", "rows", "doc_id", "part", "n", "ids"],
                )
                row += len(doc)

    return run


def _slotted(path: str, starts: dict[int, int], total: int, key: int, rows: int):
    """(bucket, slot, doc_id, part, n, ids): what a task has for each range of ``rows`` slots, in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack, item = zstandard.ZstdCompressor(_LEVEL), zstandard.ZstdDecompressor(), _item(path)
        held: list[tuple] = []

        def dealt() -> pa.RecordBatch:
            slot, n, ids = (np.concatenate([h[i] for h in held]) for i in range(3))
            doc, part = (pa.concat_arrays([h[i] for h in held]) for i in (3, 4))
            held.clear()
            order = np.argsort(slot)
            bucket = slot[order] // rows
            ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
            take = pa.array(order)
            packed = [pack.compress(spread(ids, n, order[a:b]).tobytes()) for a, b in zip([0, *ends[:-1]], ends)]
            lists = [pa.array(slot[order]), doc.take(take), part.take(take), pa.array(n[order].astype(np.int32))]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[ends - 1]), *[_listed(values, ends.tolist()) for values in lists], pa.array(packed, pa.binary())],
                ["bucket", "slot", "doc_id", "part", "n", "ids"],
            )

        for batch in batches:
            for k in range(batch.num_rows):
                own = {c: batch.column(c).slice(k, 1) for c in batch.schema.names}
                first = starts[own["task"][0].as_py()] + own["first"][0].as_py()
                n = own["n"].flatten().to_numpy().astype(np.int64)
                ids = np.frombuffer(unpack.decompress(own["ids"][0].as_py()), item)
                held.append((slots(first + np.arange(len(n)), total, key), n, ids, own["doc_id"].flatten(), own["part"].flatten()))
                if sum(h[2].nbytes for h in held) >= _DEALT_BYTES:
                    yield dealt()
        if held:
            yield dealt()

    return run


def _written(folder: str, path: str, total: int, length: int, shard_rows: int, rows: int):
    """Writes the shards of a task's buckets, each filled by slot, and passes on what is where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, item = zstandard.ZstdDecompressor(), np.dtype(_item(path))
        store, top = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(top, recursive=True)
        stride = 4 + length * item.itemsize
        held: list[tuple] = []

        def whole(bucket: int) -> pa.RecordBatch:
            base = bucket * rows
            records = np.zeros((min(rows, total - base), stride), np.uint8)
            for slot, n, _, _, ids in held:
                at = slot - base
                records[at, :4] = n.astype("<u4").view(np.uint8).reshape(-1, 4)
                place = np.repeat(at * stride + 4 - item.itemsize * (np.cumsum(n) - n), n) + item.itemsize * np.arange(len(ids))
                for byte in range(item.itemsize):
                    records.reshape(-1)[place + byte] = ids.view(np.uint8)[byte :: item.itemsize]
            for a in range(0, len(records), shard_rows):
                shard = (base + a) // shard_rows
                name = f"{top}/_{shard:08d}-{uuid.uuid4().hex}"
                with store.open_output_stream(name) as out:
                    out.write(records[a : a + shard_rows].tobytes())
                # only a whole shard gets its name; a second try of a task replaces it by the same bytes
                store.move(name, f"{top}/shard-{shard:08d}.bin")
            slot, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(slot)
            slot, take = slot[order], pa.array(order)
            doc, part = (pa.concat_arrays([h[i] for h in held]).take(take) for i in (2, 3))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(slot), pa.array((slot // shard_rows).astype(np.int32)), pa.array(slot % shard_rows * stride),
                    doc, part, pa.array(n[order].astype(np.int32)),
                ],
                ["slot", "shard", "offset", "doc_id", "part", "n_tokens"],
            )

        now = None
        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if held and bucket != now:
                    yield whole(now)
                now = bucket
                own = {c: batch.column(c).slice(k, 1) for c in ("slot", "n", "doc_id", "part", "ids")}
                held.append(
                    (
                        own["slot"].flatten().to_numpy(), own["n"].flatten().to_numpy().astype(np.int64), own["doc_id"].flatten(),
                        own["part"].flatten(), np.frombuffer(unpack.decompress(own["ids"][0].as_py()), item),
                    )
                )
        if held:
            yield whole(now)

    return run


def materialise(
    docs: DataFrame, path: str, folder: str, key: int = 1, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Writes the sequences of ``docs`` (doc_id, text) below ``folder`` and tells where each is.

    Columns: slot, shard, offset (of the record in its file shard-NNNNNNNN.bin), doc_id,
    part (number in the text), n_tokens.
    Every task of every executor must reach ``folder``. A text's ids are cut every
    ``length``; a null or empty text has no sequence. Repeated rows and null ids stay;
    further columns are not read; an empty table writes nothing. Numbers follow the
    order of the input's files, slots the numbers and ``key`` alone. The shards are written
    when the result is computed; computing it again writes the same. A task holds at most
    ``BUCKET_SHARDS`` shards at once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    listed = f"doc_id array<{kind}>, part array<int>, n array<int>, ids binary"
    rows = texts.mapInArrow(_sequences(path, length, added_tokens(path)), f"task int, first long, rows long, {listed}")
    rows = stored(rows, "sequences")
    # one number for each task of the reading stage
    counts = {r["task"]: r["n"] for r in rows.groupBy("task").agg(F.sum("rows").alias("n")).collect()}
    starts, total = {}, 0
    for task in sorted(counts):
        starts[task] = total
        total += counts[task]
    shards = -(-total // shard_rows)
    # shards are dealt in ranges: several to a task where there are more than the tasks that run at a time
    each = max(1, min(BUCKET_SHARDS, -(-shards // (4 * docs.sparkSession.sparkContext.defaultParallelism))))
    tasks = max(1, min(-(-shards // each), 10_000))
    placed = rows.mapInArrow(_slotted(path, starts, total, key, each * shard_rows), f"bucket long, slot array<long>, {listed}")
    placed = placed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(
        _written(folder, path, total, length, shard_rows, each * shard_rows),
        f"slot long, shard int, offset long, doc_id {kind}, part int, n_tokens int",
    )


def read_shard(data: bytes, length: int = SEQUENCE, item: str = "<u2") -> list[np.ndarray]:
    """The ids of every record of a shard's bytes, in slot order."""
    stride = 4 + length * np.dtype(item).itemsize
    records = [data[a : a + stride] for a in range(0, len(data), stride)]
    return [np.frombuffer(r, item, int(np.frombuffer(r, "<u4", 1)[0]), 4) for r in records]
