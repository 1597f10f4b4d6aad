"""What the pipeline cuts is shorter than what op10's contract fixes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeaudit.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_pairs import some_words


def test_pipeline_cuts_a_repeated_passage_of_fifty_words(spark, sf):
    rng = random.Random(31)
    passage = some_words(rng, 55)
    assert 200 < len(passage) < 400
    parts = {i: (some_words(rng, 80) + " ", " " + some_words(rng, 80)) for i in range(12)}
    rows = [(i, a + (passage if i < 4 else "") + b, "en", "s") for i, (a, b) in parts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    cut = {r.doc_id: r.text for r in corpus_pipeline.byte_repeats(spark, docs, sf).collect()}
    for i, text, *_ in rows:
        assert passage not in cut[i] and (i < 4 or cut[i] == text)
        assert len(cut[i]) >= len("".join(parts[i])) - 2 * 2


def test_byte_repeats_query_keeps_to_the_contracts_length(spark, sf):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, n, spans, hashlib.sha256(kept).hexdigest()) for (i, _), (kept, n, spans) in zip(docs, brute.cut_repeats([t for _, t in docs], 400))}
    got = QUERIES["op10_byte_repeats"](spark, sf).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect()
    assert set(map(tuple, got)) == want


def test_a_benchmark_item_cut_as_a_repeat_is_still_a_leak(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    leaks = {d for d, _, _ in brute.leaks(texts, items)}
    gone = min(leaks)
    cut = docs.withColumn("text", F.when(F.col("doc_id") == gone, F.lit("what is left")).otherwise(F.col("text")))
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, cut, sf).collect()}
    assert gone not in clean and clean == set(texts) - leaks


def test_pipeline_sorts_a_megabyte_at_once(spark, sf, monkeypatch):
    asked = {}

    def noted(docs, **options):
        asked.update(options)
        raise InterruptedError

    monkeypatch.setattr(corpus_pipeline.repeats, "remove_repeats", noted)
    with pytest.raises(InterruptedError):
        corpus_pipeline.byte_repeats(spark, None, sf)
    assert asked["shard"] <= 1 << 20
