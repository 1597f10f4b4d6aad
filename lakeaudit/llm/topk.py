"""Exact top-k search by distributed histogram selection.

Every task scores its rows against a block of queries and reports histograms of
its highest scores; the sums locate each query's k-th score to within one bin,
the next round divides that bin, and so on to a width of one. Then the rows at
or above the k-th score are read out and ties broken by id.

A task reports bins from the top only down to where its own count reaches k:
bins below cannot hold the global k-th score. So histograms and tied rows stay
at about k entries a task and query, however many equal vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakeaudit.llm.common import stored

#: Queries whose vectors a task holds at a time, and bins of a round.
QUERY_BLOCK = 16_384
BINS = 4_096
_SLICE = 256
_LONG = 2**63 - 1


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Ids and 256-fold rounded-down components; vectors null, or with null or non-finite parts, go."""
    x = F.col(vector_column)
    fine = x.isNotNull() & F.forall(
        x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))), F.lit(False))
    )
    return vectors.where(fine & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("double")).alias("v"),
    )


def _matrix(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the batch that have ``size`` components."""
    column = batch.column("v")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    batch = batch.filter(pa.array(lengths == size))
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return batch.column("vec_id").to_numpy(), flat.reshape(batch.num_rows, size)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; those outside the range of a long are held at its ends."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(queries.shape[1], 1)
    if bound < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(q, r)) for r in rows] for q in queries]
    return np.array([[min(max(s, -_LONG - 1), _LONG) for s in line] for line in exact], np.int64).reshape(
        len(queries), len(rows)
    )


def _blocks(batches, block, size):
    """(query numbers, ids, scores) of each batch and slice of queries; a row's own query is left out."""
    q_ids, q_vectors = block
    for batch in batches:
        for at in range(0, batch.num_rows, 2_048):
            ids, rows = _matrix(batch.slice(at, 2_048), size)
            for a in range(0, len(q_ids), _SLICE):
                scores = _scores(q_vectors[a : a + _SLICE], rows)
                yield a, ids, scores, q_ids[a : a + _SLICE, None] != ids[None, :]


def _histograms(block, size, low, width, k):
    """Per query the counts of bins from the top to the task's k-th score; bin BINS is 'above'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for a, _, scores, other in _blocks(batches, block.value, size):
            for i in range(len(scores)):
                q = a + i
                if width[q] == 0:
                    continue
                s = scores[i][other[i]]
                s = s[s >= low[q]]
                if len(s):
                    # low and width are Python integers: spans over a long stay exact
                    span = (s.astype(object) - low[q]) // width[q] if width[q] > 2**40 else (s - low[q]) // width[q]
                    bins, n = np.unique(np.minimum(span, BINS).astype(np.int64), return_counts=True)
                    if q in counts:
                        bins, n = np.concatenate((counts[q][0], bins)), np.concatenate((counts[q][1], n))
                        bins, back = np.unique(bins, return_inverse=True)
                        n = np.bincount(back, n).astype(np.int64)
                    above = n[::-1].cumsum()[::-1] - n
                    counts[q] = np.stack((bins[above < k], n[above < k]))
        for q, (bins, n) in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bins), q, np.int64)), pa.array(bins), pa.array(n)], ["q", "bin", "n"]
            )

    return run


def _winners(block, size, least, k):
    """Rows above each query's k-th score, and of the rows at it the k with the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for a, ids, scores, other in _blocks(batches, block.value, size):
            hit = (scores >= least[a : a + len(scores), None]) & other
            for i in np.flatnonzero(hit.any(axis=1)):
                found = np.stack((scores[i][hit[i]], ids[hit[i]]))
                if a + i in best:
                    found = np.concatenate((best[a + i], found), axis=1)
                best[a + i] = found[:, np.lexsort((found[1], -found[0]))[:k]]
        q_ids = block.value[0]
        for q, (score, ids) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), q_ids[q])), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"]
            )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest integer inner products of every query: query_id, rank, vec_id, score.

    Both inputs are as ``usable`` makes them. A query does not meet rows of its own
    id; all of its rows come if fewer than ``k`` exist. Ties go to the smaller id,
    repeated rows of another id each count, a repeated query counts once (its
    smallest vector). Vectors of different length are not compared. No queries or
    no vectors give no rows. Queries are taken in blocks of ``query_block``, each
    held by every task, so memory does not depend on their number.
    """
    spark = vectors.sparkSession
    asked = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    shape = asked.select(F.size("v").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("h"))
    sizes = {r["size"]: r["n"] for r in shape.groupBy("size").agg(F.count("*").alias("n")).collect()}
    out = None
    for size, n in sorted(sizes.items()):
        parts = -(-n // query_block)
        for part in range(parts):
            own = asked.where(
                (F.size("v") == size) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
            ).orderBy("vec_id").toArrow()
            ids = own.column("vec_id").to_numpy()
            if not len(ids):
                continue
            rows = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)
            block = spark.sparkContext.broadcast((ids, rows))
            same = vectors.where(F.size("v") == size)
            least = _kth(same, block, rows, size, k)
            found = same.mapInArrow(_winners(block, size, least, k), "query_id long, vec_id long, score long")
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            found = found.select("query_id", "rank", "vec_id", "score")
            found = found if parts * len(sizes) == 1 else stored(found, "topk-found")
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _kth(vectors: DataFrame, block, rows: np.ndarray, size: int, k: int) -> np.ndarray:
    """A score for each query such that at least ``k`` rows reach it, or all, and no higher one will do."""
    top = vectors.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0.0
    most = int(np.abs(rows).max(initial=0)) * int(top) * max(size, 1)
    most = min(most, _LONG)
    n = len(rows)
    low = [-most - 1] * n
    width = [(2 * most + 2) // BINS + 1] * n
    need = [k] * n
    least = np.full(n, -_LONG - 1)
    while any(width):
        counts = vectors.mapInArrow(_histograms(block, size, low, width, k), "q long, bin long, n long")
        counts = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        counts = counts.withColumn("upto", above).where(F.col("upto") - F.col("n") < k)
        seen: dict[int, tuple] = {}
        for r in counts.toArrow().to_pylist():
            if r["q"] not in seen or r["bin"] < seen[r["q"]][0]:
                seen[r["q"]] = (r["bin"], r["n"], r["upto"])
        for q in range(n):
            if not width[q]:
                continue
            if q not in seen or seen[q][2] < k:
                width[q] = 0
                continue
            at, _, upto = seen[q]
            low[q] += at * width[q]
            least[q] = min(max(low[q], -_LONG - 1), _LONG)
            width[q] = 0 if width[q] == 1 or upto == k or at == BINS else -(-width[q] // BINS)
    return least
