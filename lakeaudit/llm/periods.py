"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run of period q has at least ``power`` periods, so each of its words stands at least
``power`` times in it. A word that is rarer within a segment can belong to no run there and splits
the segment; parts are split again until nothing changes. What survives is scanned for lags:
for lags from L to 2 L - 1, with L a power of two, a run holds an aligned block of L
words that comes again one and two lags later, so only such blocks are extended to the
left and right. Blocks are compared by exact names (pairs of names of half the size), and
extended by them in steps that halve.

A text is one record; texts need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import small_batches
from lakeaudit.llm.wordlists import joined_words, word_lists

LEAST_WORDS = 6
POWER = 4
BATCH = 1 << 20
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def frequent_parts(words: np.ndarray, segment: np.ndarray, power: int, least: int) -> np.ndarray:
    """Places of the words that stand at least ``power`` times in their segment, after all splits.

    ``words`` and ``segment`` are numbers from 0; segments are runs of equal numbers. Parts of fewer than ``least`` words go.
    """
    at, out, size = np.arange(len(words)), [], int(words.max(initial=0)) + 1
    while len(at):
        _, name, n = np.unique(segment * size + words[at], return_inverse=True, return_counts=True)
        rare = n[name] < power
        split = np.bincount(segment[rare], minlength=int(segment[-1]) + 1) > 0
        out.append(at[~split[segment]])
        rest = split[segment] & ~rare
        at, segment = at[rest], segment[rest]
        if len(at):
            segment = np.cumsum(np.append(False, (np.diff(at) != 1) | (np.diff(segment) != 0)))
            long = np.bincount(segment)[segment] >= least
            at, segment = at[long], segment[long]
            segment = np.cumsum(np.append(False, np.diff(segment) != 0)) if len(at) else segment
    return np.sort(np.concatenate(out)) if out else at


def _block_names(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For sizes 1, 2, 4, ... a number for the block of that size at each place, equal for equal blocks."""
    names = [np.unique(words, return_inverse=True)[1]]
    size = 1
    while 2 * size <= min(longest, len(words)):
        now = names[-1]
        names.append(np.unique(now[:-size] * (int(now.max()) + 1) + now[size:], return_inverse=True)[1])
        size *= 2
    return names


def _agree(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from ``a`` and ``b`` on (or before them) are equal; ``a`` is below ``b``."""
    n = np.zeros(len(a), np.int64)
    for level in range(len(names) - 1, -1, -1):
        name, size = names[level], 1 << level
        while True:  # only the largest size can fit more than once
            x, y = (a + n, b + n) if forward else (a - n - size, b - n - size)
            fits = (x >= 0) & (y < len(name)) & (y >= 0)
            same = np.zeros(len(a), bool)
            same[fits] = name[x[fits]] == name[y[fits]]
            n[same] += size
            if level < len(names) - 1 or not same.any():
                break
    return n


def lag_scan(words: np.ndarray, longest: int, power: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of ``words``, of which none is longer than ``longest``.

    ``power`` is at least 4. Equal numbers are equal words.
    """
    names, found = _block_names(words, longest), []
    for level, name in enumerate(names):
        size = 1 << level
        if power * size > longest:
            break
        blocks = np.full((-(-len(name) // size), size), -1, np.int64)
        blocks.ravel()[: len(name)] = name
        row, ahead = np.nonzero(blocks[1:] == blocks[:-1, :1])
        at, lag = row * size, size + ahead
        fits = at + 2 * lag < len(name)
        at, lag = at[fits], lag[fits]
        again = name[at + 2 * lag] == name[at]
        at, lag = at[again], lag[again]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        head = np.append(True, (np.diff(lag) != 0) | (np.diff(at) != size)) if len(at) else np.zeros(0, bool)
        at, lag = at[head], lag[head]  # the following blocks of a lag are in the same run
        before, behind = _agree(names, at, at + lag, False), _agree(names, at, at + lag, True)
        length = before + lag + behind
        long = length >= np.maximum(least, power * lag)
        found.append(np.stack((at - before, length, lag))[:, long])
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch is found for multiples of its period as well
    new = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0)) if len(start) else np.zeros(0, bool)
    return start[new], length[new], period[new]


def _run_lists(power: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch]), "text", BATCH):
                words, lengths = word_lists(part.column("text"))
                code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.arange(len(lengths)), lengths)
                at = frequent_parts(code, text, power, least)
                # words of neighbouring parts are kept apart by a word of their own
                new = np.append(False, (np.diff(at) != 1) | (np.diff(text[at]) != 0)) if len(at) else np.zeros(0, bool)
                place = np.arange(len(at)) + np.cumsum(new)
                line = len(words) + np.arange(len(at) + int(new.sum()))
                where = np.full(len(line), -1, np.int64)
                line[place], where[place] = code[at], at
                parts = np.cumsum(new)
                longest = int(np.bincount(parts).max(initial=0)) if len(parts) else 0
                start, length, period = lag_scan(line, longest, power, least)
                first = where[start]
                own = text[first]
                order = np.lexsort((period, first))
                first, length, period, own = first[order], length[order], period[order], own[order]
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, first + period, 1)
                np.add.at(change, first + length, -1)
                stays = np.cumsum(change[:-1]) == 0
                begins = np.cumsum(lengths) - lengths
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (first - begins[own], length, period)], ["start", "length", "period"])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(lengths))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), runs),
                        joined_words(words.filter(pa.array(stays)), np.bincount(text[stays], minlength=len(lengths))),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, power: int = POWER, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs and collapsed of each row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII blanks. ``runs`` are the longest stretches of
    words of a smallest period q (words q apart are equal) that have at least ``power``
    (4 or more) periods and ``least`` words, with start, length and period, by start and
    period. ``collapsed`` are the words, joined by one space, without those that follow
    the first period of a run. A null or empty text has no words and no runs. Repeated rows
    and null ids stay, each judged on its own; further columns are not read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run_lists(power, least), f"doc_id {kind}, n_words bigint, runs {_RUNS}, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with a tail made periodic in about every tenth text, by the checksum of its id.

    With h = crc32(decimal doc_id), g = h div 10 and n words: if h is a multiple of 10, word i from
    a = g mod n on becomes word a + (i - a) mod p, with p = 1 + (n - a) div (3 + g mod 8).
    Other texts, and those of a null id or without words, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    some = F.col("w").isNotNull() & (F.size("w") > 0)
    rows = rows.select("doc_id", "text", "w", some.alias("some"), n.alias("n"), g.alias("g"), F.when(some, g % n).alias("a"))
    p = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    rows = rows.withColumn("p", p)
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), times))
    whole = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n").cast("int"))
    return rows.select("doc_id", F.when(F.col("some"), F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and the number of words."""
    run = F.col("run")
    better = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    best: Column = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(better(a, r), r).otherwise(a))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("run", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), run["start"].alias("start"), run["length"].alias("length"),
        run["period"].alias("period"), F.floor(1000 * run["length"] / run["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
