"""Edit-aware token counts: segment trees over the pieces of every document.

A document's pieces (which encode on their own) stand in leaves of about ``LEAF``
pieces; every inner node of the tree has the characters and tokens below it. An edit
goes down the tree by characters to the leaves it touches, takes as much text around
as a cut can depend on, encodes the pieces of this region alone, and puts new sums on
the paths from its leaves to the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import list_column, small_batches
from lakeaudit.llm.pieces import Encoder, added_tokens, coded_texts, cut

LEAF = 16
EDITS = "array<struct<start:bigint,stop:bigint,insert:string>>"
# What a task holds at once of the bytes of text to cut, and of those under edit.
_BATCH_BYTES = 2_000_000
_EDITED_BYTES = 4_000_000


class Tree:
    """Characters and tokens of the leaves, with sums in heap order: node i has 2i and 2i + 1 below it."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.size = 1 << max(0, int(len(chars) - 1).bit_length()) if len(chars) else 1
        self.leaves = len(chars)
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars)] = np.stack((chars, tokens), axis=1)
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for what is behind) and its first character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return min(node - self.size, max(self.leaves - 1, 0)), before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.size + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def columns(self) -> np.ndarray:
        return self.sums[self.size : self.size + self.leaves]


def _dealt(values: np.ndarray, leaves: int) -> np.ndarray:
    """Rows of ``values`` summed into ``leaves`` parts of even length, in order."""
    cuts = np.arange(leaves + 1) * len(values) // max(leaves, 1)
    sums = np.concatenate((np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, axis=0)))
    return sums[cuts[1:]] - sums[cuts[:-1]]


def edit(text: str, tree: Tree, start: int, stop: int, insert: str, encoder: Encoder, added: list[str]) -> tuple[str, Tree, int]:
    """Text and tree after ``text[start:stop] = insert``, and how many pieces were encoded for it."""
    start, stop = max(0, min(start, len(text))), max(0, min(stop, len(text)))
    stop = max(start, stop)
    # a cut depends on a character on either side, or on an added token around it
    reach = max([1, *map(len, added)])
    first, lo = tree.find(max(start - reach, 0))
    last, hi = tree.find(min(stop + reach, len(text)))
    hi += int(tree.sums[tree.size + last, 0])
    now = text[lo:start] + insert + text[stop:hi]
    parts = cut(now, added)
    sizes = encoder.ids(parts)[1]
    values = np.stack((np.array([len(p) for p in parts], np.int64), sizes), axis=1) if parts else np.zeros((0, 2), np.int64)
    leaves = last - first + 1
    if len(parts) <= 2 * LEAF * leaves and tree.leaves:
        for leaf, (chars, tokens) in enumerate(_dealt(values, leaves), first):
            tree.put(leaf, int(chars), int(tokens))
    else:
        own = tree.columns()
        own = np.concatenate((own[:first], _dealt(values, -(-len(parts) // LEAF)), own[last + 1 :]))
        tree = Tree(own[:, 0], own[:, 1])
    return text[:start] + insert + text[stop:], tree, len(parts)


def _built(path: str, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in small_batches(iter([batch]), "text", _BATCH_BYTES):
                words, at, lengths = coded_texts(part.column("text"), added)
                chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                values = np.stack((chars, encoder.ids(words.to_pylist())[1]), axis=1)
                leaves = -(-lengths // LEAF)
                number = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                heads = np.flatnonzero(number % LEAF == 0)
                sums = np.add.reduceat(values[at], heads, axis=0) if len(heads) else values[:0]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), list_column(sums[:, 0], leaves, pa.int64()), list_column(sums[:, 1], leaves, pa.int64())],
                    ["doc_id", "text", "leaf_chars", "leaf_tokens"],
                )

    return run


def build_trees(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, leaf_chars, leaf_tokens of every row of ``docs`` (doc_id, text): the trees' lowest level.

    A null text is empty and has no leaves. Repeated rows and null ids stay; further
    columns are not read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    return rows.mapInArrow(_built(path, added_tokens(path)), f"doc_id {kind}, text string, leaf_chars array<long>, leaf_tokens array<long>")


def apply_edits(trees: DataFrame, path: str) -> DataFrame:
    """Trees with a column ``edits`` (of type ``EDITS``), after these edits one after the other.

    Columns: doc_id, text, leaf_chars, leaf_tokens (of the new text), n_edits,
    tokens_before, tokens_after, recounted (pieces encoded for the edits). Positions are
    code points of the text as it is then, held to its ends; a null position is 0, a null
    insert nothing, null edits are none.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    added = added_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in small_batches(iter([batch]), "text", _EDITED_BYTES):
                out: list[list] = [[] for _ in range(7)]
                for text, chars, tokens, edits in zip(*(part.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits"))):
                    tree, before, again, text = Tree(np.array(chars or [], np.int64), np.array(tokens or [], np.int64)), sum(tokens or []), 0, text or ""
                    for e in edits or []:
                        text, tree, n = edit(text, tree, e["start"] or 0, e["stop"] or 0, e["insert"] or "", encoder, added)
                        again += n
                    own = tree.columns()
                    for column, value in zip(out, (text, own[:, 0], own[:, 1], len(edits or []), before, tree.tokens, again)):
                        column.append(value)
                kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                    ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_edits", "tokens_before", "tokens_after", "recounted"],
                )

    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col("edits").cast(EDITS)).mapInArrow(
        run,
        f"doc_id {kind}, text string, leaf_chars array<long>, leaf_tokens array<long>, "
        "n_edits long, tokens_before long, tokens_after long, recounted long",
    )


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees with the edits of a table (doc_id, number, start, stop, insert), in order of their number.

    Edits of unknown documents are left out. The edits of one document are one record.
    """
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("number", "start", "stop", "insert"))).alias("edits"))
    own = own.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["insert"].alias("insert"))))
    return trees.join(own, "doc_id", "left")
