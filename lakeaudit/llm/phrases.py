"""Phrase collocations by vertical partitioning of the word suffixes.

1. Every word of a text begins a suffix, cut at ``most`` words or at the end of its
   piece. A task counts its equal suffixes and packs them by the group of their first
   word: a group of one task is a small subtree, written as its sorted leaves.
2. Groups are sized by their leaves. A group above ``budget`` leaves is dealt over
   several by one word more of the suffix, again and again up to whole suffixes, so no
   subtree exceeds a task's memory, however frequent a word or phrase is.
3. Each group is merged into one subtree, independently of the others. The count of a
   phrase is the leaf total below its node; nodes shorter than the words their group was
   dealt by lie in several groups and are added up.
4. Counts of the parts of each cut come by joins, scores are exact decimals, and the first
   phrases of a language are taken in two steps so that no task ranks a whole language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeaudit.llm.common import stored, tidy
from lakeaudit.llm.wordlists import joined_words, word_lists

MOST = 3
LEAST = 10
TOP = 2_000
#: Groups at first, leaves a merged group may have, bytes of text that a task counts at once.
GROUPS = 128
BUDGET = 1 << 21
CHUNK = 4 << 20
_SALTS = 64
#: What ends a piece, and the unknown language.
ENDS = ".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + ENDS.encode() + b"\t", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" ")
_TREE = "lang string, part int, depth int, slot int, leaves long, packed binary"


def _leaves(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of coded words in order, and their summed counts."""
    name = np.zeros(len(words), np.int64)
    for column in words.T:
        name = np.unique(name * (int(column.max(initial=0)) + 1) + column, return_inverse=True)[1]
    order = np.argsort(name, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(name[order]) != 0)) if len(name) else order
    return words[order[heads]], np.add.reduceat(counts[order], heads) if len(heads) else counts


def _suffixes(texts: list[bytes], most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and the distinct suffixes of all texts as numbers of words (0: none) with their counts."""
    data = b"\n".join(texts).translate(_TABLE)
    pieces = pc.split_pattern(pa.array([data.decode()]), "\n").flatten()
    words, lengths = word_lists(pieces)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    piece = np.repeat(np.arange(len(lengths)), lengths)
    rows = np.zeros((len(code), most), np.int64)
    for k in range(min(most, len(code))):
        end = len(code) - k
        rows[:end, k] = np.where(piece[k:] == piece[:end], code[k:], 0)
    return coded.dictionary, *_leaves(rows, np.ones(len(code), np.int64))


def _slots(hashes: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the first ``depth`` words of each suffix; ``hashes`` are the words', from number 1."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(depth):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[rows[:, k]]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out >> np.uint64(33)


def _hashes(words: pa.Array) -> np.ndarray:
    crc = [zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()]
    return np.array([0, *crc], np.uint64) * np.uint64(0xD1342543DE82EF95)


def _packed(words: pa.Array, rows: np.ndarray, counts: np.ndarray) -> bytes:
    own, at = np.unique(rows, return_inverse=True)
    texts = words.take(pa.array(own[own > 0] - 1)).cast(pa.binary()).to_pylist()
    at = at.reshape(rows.shape) + (1 if len(own) and own[0] > 0 else 0)
    kind = "<u2" if len(texts) < 65_535 else "<u4"
    head = np.array([len(rows), rows.shape[1], len(texts), int(kind[-1])], "<i8").tobytes()
    body = head + at.T.astype(kind).tobytes() + counts.astype("<i8").tobytes() + b"\n".join(texts)
    return zstandard.compress(body, 3)


def _unpacked(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    body = zstandard.decompress(data)
    n, most, size, width = np.frombuffer(body, "<i8", 4).tolist()
    upto = 32 + n * most * width
    rows = np.frombuffer(body, f"<u{width}", n * most, 32).reshape(most, n).T.astype(np.int64)
    counts = np.frombuffer(body, "<i8", n, upto)
    words = pa.array(body[upto + 8 * n :].decode().split("\n") if size else [], pa.string())
    return words, rows, counts


def _trees(words: pa.Array, rows: np.ndarray, counts: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """For each group its number, leaves and packed leaves."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else order
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = np.sort(order[a:b])
        yield int(group[own[0]]), len(own), _packed(words, rows[own], counts[own])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("lang", pa.string()), ("part", pa.int32()), ("depth", pa.int32()), ("slot", pa.int32()), ("leaves", pa.int64()), ("packed", pa.binary()))
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


def _local(most: int, groups: int):
    """The subtrees of a task's texts: all suffixes of about CHUNK bytes of a language at a time."""

    def made(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        words, rows, counts = _suffixes(texts, most)
        group = (_slots(_hashes(words), rows, 1) % np.uint64(groups)).astype(np.int64)
        return _batch([(lang, g, 1, 0, n, data) for g, n, data in _trees(words, rows, counts, group)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= CHUNK or sum(size.values()) >= 4 * CHUNK:
                    lang = max(size, key=size.get)
                    yield made(lang, held.pop(lang))
                    size.pop(lang)
        for lang, texts in held.items():
            yield made(lang, texts)

    return run


def _dealt(depth: int, budget: int):
    """Subtrees of too large groups, cut by a word more into so many that each is about half the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, part, total, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "total", "packed"))):
                words, rows, counts = _unpacked(data)
                parts = -(-2 * total // budget)
                slot = (_slots(_hashes(words), rows, depth) % np.uint64(parts)).astype(np.int64)
                out += [(lang, part, depth, g, n, own) for g, n, own in _trees(words, rows, counts, slot)]
            yield _batch(out)

    return run


def _merged(trees: list[bytes], extra: tuple | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One subtree of packed ones and of a merged one."""
    parts = [_unpacked(t) for t in trees] + ([extra] if extra else [])
    coded = pa.concat_arrays([p[0].cast(pa.string()) for p in parts]).dictionary_encode()
    code = np.append(0, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    begins = np.cumsum([0, *[len(p[0]) for p in parts]])
    rows = np.concatenate([code[np.where(p[1] > 0, p[1] + b, 0)] for p, b in zip(parts, begins)])
    return coded.dictionary, *_leaves(rows, np.concatenate([p[2] for p in parts]))


def _nodes(lang: str, depth: int, least: int, tree: tuple[pa.Array, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Phrases of a merged subtree and their leaf totals; ``size`` 0 is the number of all words."""
    words, rows, counts = tree
    columns = ["lang", "size", "phrase", "f"]
    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([int(counts.sum())])], columns)
    for size in range(1, rows.shape[1] + 1):
        whole = rows[:, size - 1] > 0
        phrase, f = _leaves(rows[whole][:, :size], counts[whole])
        if size >= depth:  # the node lies in this group alone
            phrase, f = phrase[f >= least], f[f >= least]
        if len(f):
            text = joined_words(words.take(pa.array(phrase.ravel() - 1)), np.full(len(f), size))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(np.full(len(f), size, np.int32)), text, pa.array(f)], columns)


def _subtrees(least: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size, tree = None, [], 0, None
        for batch in batches:
            for *group, leaves, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "depth", "slot", "leaves", "packed"))):
                if group != name:
                    if name is not None:
                        yield from _nodes(name[0], name[2], least, _merged(held, tree))
                    name, held, size, tree = group, [], 0, None
                held.append(data)
                size += leaves
                if size > budget:  # equal leaves of many tasks become one
                    tree, held, size = _merged(held, tree), [], 0
        if name is not None:
            yield from _nodes(name[0], name[2], least, _merged(held, tree))

    return run


def phrase_counts(docs: DataFrame, most: int = MOST, least: int = LEAST, groups: int = GROUPS, budget: int = BUDGET) -> DataFrame:
    """lang, size, phrase, f: all phrases of 1 to ``most`` words that occur at least ``least`` times in a language.

    A row of size 0 has the number of all words of the language. See ``collocations``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text.alias("text"))
    trees = stored(rows.where(F.octet_length("text") > 0).mapInArrow(tidy(_local(most, groups)), _TREE), "phrase-trees")
    group = ["lang", "part", "depth", "slot"]
    for depth in range(2, most + 1):
        # at most one row for each ``budget`` leaves
        large = trees.where(F.col("depth") == depth - 1).groupBy(*group).agg(F.sum("leaves").alias("total")).where(F.col("total") > budget)
        large = stored(large, "phrase-large")
        if large.isEmpty():
            break
        rest = trees.join(large, group, "left_anti")
        trees = stored(rest.unionByName(trees.join(large, group).mapInArrow(tidy(_dealt(depth, budget)), _TREE)), "phrase-trees")
    merged = trees.repartition(*group).sortWithinPartitions(*group)
    nodes = merged.mapInArrow(tidy(_subtrees(least, budget)), "lang string, size int, phrase string, f long")
    return nodes.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, groups: int = GROUPS, budget: int = BUDGET) -> DataFrame:
    """The first ``top`` phrases of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and cut into pieces at ``ENDS``, pieces into words at
    spaces and tabs. A phrase of 2 to ``most`` words that occurs a >= ``least`` times in the
    pieces of a language is a candidate; cut into parts that occur l and r times it
    scores floor(1000000 a a / (l r)), and its lowest cut counts, the earliest of equal ones.
    A candidate inside a longer one with at least half its count is dropped.
    Order is by score, then a, both descending, then phrase. n is the number of all words of the language.
    A null text is empty, a null language is ``UNKNOWN``; repeated rows count each time;
    other columns, doc_id too, are not read; an empty table gives no rows. Arithmetic is exact up to counts of 10^12.
    """
    counts = stored(phrase_counts(docs, most, least, groups, budget), "phrase-counts")
    known = counts.where("size > 0")
    some = known.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size")
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = some.select("lang", "phrase", "a", "size", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda column, f: known.select("lang", F.col("phrase").alias(column), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20,0)) * a * 1000000) div (cast(l as decimal(20,0)) * r)")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"))

    longer = some.where("size > 2").select("lang", "a", "size", words.alias("w"))
    longer = longer.select("lang", "a", "size", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    longer = longer.select("lang", "a", "w", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("first"))
    longer = longer.select("lang", part(F.col("first"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = scored.join(longer, ["lang", "phrase"], "left").where("inside is null or 100 * inside < 50 * a")
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return left.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
