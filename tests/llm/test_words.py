"""Repeated passages, periodic runs and phrases against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeaudit.llm import passages, periods, phrases

DOCS = "doc_id long, text string"
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "x", "　a　b  a\x1cb c\x0bd\x0ce\r\n", "word " * 3_000, "a b " * 40, "é ü " * 30 + "."]


def listed(text):
    return [w for w in BLANKS.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(rng, n, size=40):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % size}" for _ in range(n))


def passage_brute(rows, length):
    """For each distinct (order, text): words left, removed words and removed runs; ``rows`` are (order, text)."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: r[0]):
        own, gone = listed(text), set()
        for i in range(len(own) - length + 1):
            window = tuple(own[i : i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        out[key, text] = (len(own), len(gone), sha(" ".join(w for i, w in enumerate(own) if i not in gone)),
                          sum(1 for i in gone if i - 1 not in gone), len(text or "") - sum(len(own[i]) for i in gone))
    return out


def passage_rows(n=60):
    rng = random.Random(5)
    passage, line = prose(rng, 60, 4_000), prose(rng, 14, 4_000)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(100, 100 + n):
        kind = i % 4
        text = prose(rng, rng.randint(0, 120), 5_000)
        if kind == 0:
            text += "  " + passage + "\n" + prose(rng, 30, 5_000)
        if kind == 1:
            text += " " + line + " " + prose(rng, 5, 9) + " " + line
        if kind == 2:
            text = rows[rng.randrange(len(rows))][1] or ""
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("length,group", [(20, passages.GROUP), (20, 150), (9, 400)])
def test_passages_equal_brute_force(spark, length, group):
    rows = passage_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("content", F.lit("clash")).withColumn("start", F.lit(3))
    got = passages.digest(passages.remove_passages(df.repartition(5), length, group)).collect()
    want = passage_brute(rows, length)
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: want[i, t] for i, t in rows} and len(got) == len(rows)


def test_passages_of_repeated_rows_null_and_text_ids(spark):
    rng = random.Random(6)
    text, other = prose(rng, 70, 4_000), prose(rng, 30, 4_000)
    rows = [("b", text), ("b", text), ("b", None), (None, text + " " + other), ("a", other), ("a", text[:200] + " " + other), ("a", other)]
    got = passages.remove_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows)
    whole = [r for r in got if r.doc_id is None]
    assert whole[0].n_words == 100 and not whole[0].spans
    assert all(r.kept == "" for r in got if r.doc_id == "b")
    assert len({(r.doc_id, r.h, r.kept) for r in got}) == 5  # equal rows have one result
    assert passages.remove_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_many_equal_rows_cost_no_more_than_different_ones(spark):
    text = prose(random.Random(7), 300, 4_000)
    df = spark.range(4_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    assert passages.digest(passages.remove_passages(df)).agg(F.sum("n_removed"), F.count("*")).first()[:] == (0, 4_000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(2, 9))
def test_deep_nodes_are_equal_windows(words, length):
    starts = np.arange(max(len(words) - length + 1, 0))
    node = passages.deep_nodes(np.array(words), starts, length)
    windows = [tuple(words[i : i + length]) for i in starts]
    assert [[x == y for y in node] for x in node] == [[x == y for y in windows] for x in windows]
    assert [windows[i] for i in np.argsort(node, kind="stable")] == sorted(windows)


def runs_brute(words, power=4, least=6):
    out = set()
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            own = words[i : i + size]
            if size >= max(least, power * q) and all(own[p:] != own[:-p] for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def period_digest(doc_id, text):
    words = periodic(doc_id, listed(text))
    runs = runs_brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words),
    )


def test_periods_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [*ODD[:5], "word " * 300, *ODD[6:]]
    for _ in range(120):
        unit = prose(rng, rng.randint(1, 9), 3)
        texts.append(prose(rng, rng.randint(0, 30), 6) + " " + (unit + " ") * rng.randint(1, 9) + prose(rng, rng.randint(0, 200), 5))
    texts += [" ".join(["a b a b a c"] * 12), "a a b " * 30 + "a a b a a a " * 20, prose(rng, 1500, 200)]
    rows = [*enumerate(texts), (3, "x y " * 5), (3, "x y " * 5), (None, "z " * 7)]
    df = spark.createDataFrame(rows, DOCS).withColumn("w", F.lit(1)).withColumn("h", F.lit(2)).withColumn("runs", F.lit(3))
    got = periods.digest(periods.periodic_runs(periods.with_periods(df))).collect()
    assert Counter(map(tuple, got)) == Counter(period_digest(*r) for r in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert periods.digest(periods.periodic_runs(df.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=90), st.integers(1, 6))
def test_lag_scan_finds_every_run(words, times):
    words = words[: len(words) // 2] + words[len(words) // 2 :][:11] * times
    got = periods.lag_scan(np.array(words), len(words), 4, 6)
    assert sorted(zip(*(x.tolist() for x in got)), key=lambda r: (r[0], r[2])) == runs_brute(words)


def test_a_very_long_periodic_text(spark):
    rng = random.Random(2)
    unit = [f"u{i}" for i in range(40_000)]
    text = " ".join(unit * 5 + ["end"] + ["a"] * 200_000 + [f"v{rng.randrange(50)}" for _ in range(100_000)])
    found = periods.periodic_runs(spark.createDataFrame([(1, text)], DOCS)).first()
    assert [tuple(r) for r in found.runs if r.length > 1_000] == [(0, 200_000, 40_000), (200_001, 200_000, 1)]


def phrase_brute(rows, least, top, most=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(own)
            for size in range(1, most + 1):
                f.update((lang, *own[i : i + size]) for i in range(len(own) - size + 1))
    some = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = []
    for (lang, *words), a in some.items():
        inside = [k for k in some if k[0] == lang and len(k) - 1 > len(words)
                  and any(list(k[i : i + len(words)]) == words for i in range(1, len(k)))]
        if any(100 * some[k] >= 50 * a for k in inside):
            continue
        cuts = [(10**6 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words), f[lang, *words[:k]], f[lang, *words[k:]]))
    ranked, at = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out, key=lambda x: (*x[:3], x[3].encode())):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], phrase, -a, left, right, n[lang], -score))
    return ranked


@pytest.mark.parametrize("most,groups,budget,chunk", [(3, 128, 1 << 22, 1 << 20), (3, 2, 40, 3_000), (4, 3, 100, 500)])
def test_phrases_equal_brute_force(spark, monkeypatch, most, groups, budget, chunk):
    rng = random.Random(4)
    texts = [(None, None), ("en", ""), (None, "\n\n"), ("de", "Ab ab. AB ab, Äb äb! " * 30), (None, "x\ty  z\x1cq\xa0 x y z " * 15), ("", "one")]
    texts += [(rng.choice(["en", "de", "en"]), prose(rng, 60, 12) + rng.choice([". ", " ", "\n"]) + prose(rng, 30, 30)) for _ in range(60)]
    texts += texts[-3:]  # repeated rows
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    df = spark.createDataFrame(texts, "lang string, text string").withColumn("size", F.lit(1)).withColumn("phrase", F.lit("clash"))
    got = phrases.collocations(df.repartition(3), most, 10, 40, groups, budget).collect()
    assert sorted(map(tuple, got)) == sorted(phrase_brute(texts, 10, 40, most))
    assert phrases.collocations(df.limit(0)).count() == 0


def test_packed_subtrees_read_back():
    words, rows, counts = phrases._suffixes(["a b. c".encode(), "é a b".encode()], 3)
    again = phrases._unpacked(phrases._packed(words, rows[1:], counts[1:]))
    name = lambda w, r: [tuple(w[int(c) - 1].as_py() if c else "" for c in x) for x in r]
    assert name(again[0], again[1]) == name(words, rows[1:]) and list(again[2]) == list(counts[1:])
    assert sum(counts) == 6
