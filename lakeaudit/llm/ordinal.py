"""Quality grades by ordinal cumulative-link regression on hashed text.

One weight per hashed feature is shared by all grades; ordered thresholds cut the
weighted sum s: P(grade >= j) = sigmoid(s - threshold_j). The expected grade is the
sum of these tails, and a document is selected by the tail of the top grade.

Features of a text: its lower-cased words, their first letters, its symbol runs,
and how much of it is repeated, upper case or symbols, in tenths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import small_batches, stored, tidy

#: Labelled documents that the model is fitted on, at most: those of the smallest hashes.
FIT_ROWS = 16_000
#: Weights of the model at most: the features that tell grades apart best.
FEATURES = 4_096
_LEAST_Z = 5.0
#: Words whose features a task remembers, none longer than so many characters; words of a batch.
_MEMO = 50_000
_MEMO_LENGTH = 40
_BATCH_WORDS = 250_000


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes, their weights, and ascending thresholds (none: nothing was learnt)."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0))


def _hash(name: str) -> int:
    return xxhash.xxh64_intdigest(name)


def _features_of(part: str) -> tuple[int, int, bool, bool]:
    """Hashes of what a word or symbol run shows, 0 for nothing; whether it is upper case, or symbols."""
    if not part[0].isalpha():
        return _hash("s:" + part[:8]), 0, False, True
    low = part.lower()
    return _hash("w:" + low), _hash("p:" + low[:4]) if len(low) > 4 else 0, len(part) > 1 and part.isupper(), False


def _batch_features(column: pa.Array, memo: dict) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, hash) pairs, each once, of a batch of part lists."""
    n = len(column)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    coded = flat.dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if len(memo) > _MEMO:
        memo.clear()
    table = np.zeros((len(words), 2), np.uint64)
    upper = np.zeros(len(words), bool)
    symbol = np.zeros(len(words), bool)
    for i, w in enumerate(words):
        if (f := memo.get(w)) is None:
            f = _features_of(w)
            if len(w) <= _MEMO_LENGTH:
                memo[w] = f
        table[i] = f[:2]
        upper[i], symbol[i] = f[2], f[3]
    doc = np.repeat(np.arange(n), lengths)
    pairs_doc, pairs_hash = [doc, doc], [table[at, 0], table[at, 1]] if len(at) else [np.zeros(0, np.uint64)] * 2
    again = np.zeros(len(at), bool)
    for lag in (1, 2):
        again[lag:] |= (at[lag:] == at[:-lag]) & (doc[lag:] == doc[:-lag])
    some = lengths > 0
    for name, flag in (("again", again), ("upper", upper[at] if len(at) else again), ("symbol", symbol[at] if len(at) else again)):
        share = np.bincount(doc[flag], minlength=n)[some] / lengths[some]
        names = np.array([_hash(f"{name}:{i}") for i in range(11)], np.uint64)
        pairs_doc.append(np.flatnonzero(some))
        pairs_hash.append(names[np.floor(share * 10).astype(int)])
    d, h = np.concatenate(pairs_doc), np.concatenate(pairs_hash)
    return d[h != 0], h[h != 0], n


def _distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def _graded_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}
    for batch in batches:
        for part in small_batches(iter([batch]), "parts", _BATCH_WORDS):
            doc, value = _distinct(*_batch_features(part.column("parts"), memo)[:2])
            offsets = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("grade"), lists], ["row", "grade", "features"])


def fit(docs: DataFrame, grades: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> Model:
    """The model for ``grades`` (doc_id, grade from 0) of ``docs`` (doc_id, text).

    At most ``fit_rows`` labelled documents are used, those with the smallest id
    hashes and of rows of one id that with the least text, and at most ``features`` weights. Null ids or grades do not count; a
    document graded twice has its lowest grade; grades of unknown documents are not
    used. With fewer than two grades nothing is learnt.
    """
    known = grades.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # one text of each sampled id, so that copies neither weigh nor exceed the bound
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = rows.select(F.xxhash64("doc_id").alias("row"), "grade", _parts(F.col("text")).alias("parts"))
    rows = rows.mapInArrow(tidy(_graded_features), "row long, grade int, features array<long>")
    rows = stored(rows, "graded-features")
    counts = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    total = sum(counts.values())
    per = rows.select("grade", F.explode("features").alias("h")).groupBy("h").agg(
        F.count("*").alias("n"), *[F.avg((F.col("grade") == g).cast("double")).alias(f"g{g}") for g in sorted(counts)]
    )
    off = [F.abs(F.col(f"g{g}") - n / total) / (n / total * (1 - n / total)) ** 0.5 for g, n in counts.items()]
    z = F.greatest(*off) * F.sqrt("n")
    chosen = per.where(z >= _LEAST_Z).orderBy(F.desc(z), "h").limit(features).select("h").collect()
    hashes = np.sort(np.array([r["h"] for r in chosen], np.int64))
    index = F.broadcast(rows.sparkSession.createDataFrame([(int(h), i) for i, h in enumerate(hashes)], "h long, i int"))
    used = rows.select("row", F.explode("features").alias("h")).join(index, "h")
    used = rows.select("row", "grade").join(used.groupBy("row").agg(F.collect_list("i").alias("at")), "row", "left").toArrow()
    at = used.column("at").combine_chunks()
    lengths = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    weights, thresholds = regression(
        np.repeat(np.arange(len(lengths)), lengths), at.flatten().to_numpy(), used.column("grade").to_numpy(), len(hashes)
    )
    return Model(hashes.view(np.uint64), weights, thresholds)


def regression(
    row: np.ndarray, column: np.ndarray, grade: np.ndarray, size: int, steps: int = 400, penalty: float = 0.02
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by full-batch Adam steps.

    ``row`` and ``column`` are the places of the ones of a 0/1 matrix.
    """
    n, levels = len(grade), int(grade.max())
    share = np.array([np.clip((grade >= j).mean(), 1e-3, 1 - 1e-3) for j in range(1, levels + 1)])
    first = -np.log(share / (1 - share))
    # thresholds are a start and logarithms of steps, so that they stay in order
    values = np.concatenate((np.zeros(size), first[:1], np.log(np.maximum(np.diff(first), 0.05))))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    m, v = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate((values[size : size + 1], np.exp(values[size + 1 :]))))
        s = np.bincount(row, values[column], minlength=n)
        tails = np.concatenate((np.ones((n, 1)), sigmoid(s[:, None] - cuts[None, :]), np.zeros((n, 1))), axis=1)
        slopes = tails * (1 - tails)
        at = np.arange(n)
        p = np.maximum(tails[at, grade] - tails[at, grade + 1], 1e-9)
        by_s = -(slopes[at, grade] - slopes[at, grade + 1]) / p / n
        by_cut = np.zeros(levels)
        for j in range(1, levels + 1):
            by_cut[j - 1] = ((slopes[:, j] / p)[grade == j].sum() - (slopes[:, j] / p)[grade == j - 1].sum()) / n
        tail_sum = by_cut[::-1].cumsum()[::-1]
        by_value = np.concatenate((
            np.bincount(column, by_s[row], minlength=size) + penalty * values[:size] / n,
            tail_sum[:1],
            tail_sum[1:] * np.exp(values[size + 1 :]),
        ))
        m, v = 0.9 * m + 0.1 * by_value, 0.99 * v + 0.01 * by_value**2
        values = values - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return values[:size], np.cumsum(np.concatenate((values[size : size + 1], np.exp(values[size + 1 :]))))


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part in small_batches(iter([batch]), "parts", _BATCH_WORDS):
                doc, value, n = _batch_features(part.column("parts"), memo)
                s = np.zeros(n)
                if len(model.hashes) and len(value):
                    at = np.minimum(np.searchsorted(model.hashes.view(np.int64), value.view(np.int64)), len(model.hashes) - 1)
                    known = model.hashes[at] == value
                    doc, at = _distinct(doc[known], at[known])
                    s = np.bincount(doc, model.weights[at], minlength=n)
                tails = 1 / (1 + np.exp(-np.clip(s[:, None] - model.thresholds[None, :], -40, 40)))
                top = tails[:, -1]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in part.schema.names if c != "parts"], pa.array(tails.sum(axis=1)), pa.array(top)],
                    [*[c for c in part.schema.names if c != "parts"], "expected_grade", "p_top"],
                )

    return run


def select(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text ``grade`` would keep.

    Each row is judged on its own: repeated rows and null ids stay or go by their text, a null or
    empty text by the thresholds alone; an empty table gives no rows.
    """
    if not len(model.thresholds):
        return docs
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kind = docs.select(whole.alias("row")).schema["row"].dataType.simpleString()
    rows = docs.select(whole.alias("row"), _parts(F.col("text")).alias("parts"))
    rows = rows.mapInArrow(tidy(_scorer(model)), f"row {kind}, expected_grade double, p_top double")
    return rows.where(F.col("p_top") >= least).select("row.*")


def grade(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_top (that the grade is the highest) and keep, for each row of ``docs``.

    A null or empty text has no features and gets the grades of the thresholds alone.
    Repeated rows and null ids stay; further columns are not read. With a model that
    learnt nothing all rows are kept and the grades are null.
    """
    if not len(model.thresholds):
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("expected_grade"), none.alias("p_top"), F.lit(True).alias("keep"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _parts(F.col("text")).alias("parts"))
    rows = rows.mapInArrow(tidy(_scorer(model)), f"doc_id {kind}, expected_grade double, p_top double")
    return rows.withColumn("keep", F.col("p_top") >= least)


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings of the label table: 0 poor, 1 toxic, 2 good; null where a label is missing."""
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return labels.select("doc_id", F.when(poor, 0).when(toxic, 1).when(~poor & ~toxic, 2).alias("grade"))
