"""Chat formatting, license scan, grades, BPE, edits and training order on small hard cases."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeaudit.llm import chat, edits, licenses, order, ordinal, wordtable
from lakeaudit.llm.pieces import Encoder, added_tokens, cut, encode, tokenizer

DOCS = "doc_id long, text string"
ODD = [
    (-1, None), (-2, ""), (None, "x y"), (None, "x y"), (-6, "word " * 30_000),
    (-3, "a<|endoftext|>b  <|endoftext|> it's we'll 'll   x\t\n\r\n y .. ,a b12 3́é'é ∑! <|endoftext|"),
    (-4, "日本語 　テキスト。​x ﻿ z \U0001f600"), (-5, "a\x1c b\x85\x0b c  \n"),
]
TALKS = [
    (1, 0, "user", "</s>[INST] ok \\ <|im_end|>\n[/INST]"), (1, 1, "assistant", "a\\|<\\|b <<SYS>>"), (1, 2, "us\ner", None),
    (2, None, None, "first"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, 1, "assistant", ""),
    (3, 0, "user", "no reply"), (None, 5, "assistant", "lost"),
]


def test_chat_reads_back(spark):
    rows = spark.createDataFrame([(*r, "clash") for r in TALKS], "conv_id long, turn int, role string, text string, pieces string")
    made = chat.examples(rows)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in {r[0] for r in TALKS}:
        own = sorted((r[1:] for r in TALKS if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[1] or "", r[2] or "") for r in own]
        assert got[conv].trained == "".join(r[2] or "" for r in own if r[1] == "assistant")
    for r in made.collect():
        context = r.text[: r.loss_start]
        assert r.text[r.loss_end :] == chat.END and context.count(chat.START) == r.text.count(chat.START)
    assert made.where("conv_id = 1").count() == 2  # one reply, and the turn behind it
    assert chat.digest(chat.examples(rows.limit(0))).count() == 0


def license_brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label) for phrase, label in licenses.BASE for i in range(len(own))
        if own[i : i + len(phrase.split())] == phrase.split()
    ]
    joined, found = " " + " ".join(own) + " " if own else " ", []
    for priority, (label, word, pattern, _) in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", joined):
            assert word in joined
            start = joined[: m.start()].count(" ") - 1
            found.append((start, -(start + m[0].count(" ") + 1), priority, label))
    kept, upto = [], 0
    for d in sorted(found):
        if -d[1] > upto:
            kept.append(d[3])
            upto = -d[1]
    return len(own), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(
        sorted({x for _, x in places} | set(kept)))


def test_licenses_equal_brute_force(spark):
    texts = [
        "Licensed under CC BY-NC 4.0. MIT License mit license", "the Apache License, Version 2.0 ok", None, "", "MIT", "mit-license",
        "Licensed under the Apache License, Version 2.0.\nOs los", "GNU General Public License v3", "SPDX-License-Identifier: GPL-2.0 MIT License",
        "released under the 2-clause BSD licence; governed by the Mozilla Public License 2.0", "ÉMIT License üMIT license",
        "MIT License " * 4_000, "under GPLv3 or LGPLv2.1+, AGPLv3, Apache2, BSD3", "gplv gplv9 agplv3.1",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software. MIT License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "I hope the author can retain it",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])], DOCS).withColumn("words", F.lit(1))
    got = licenses.digest(licenses.scan(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in got) == Counter(
        (i, *license_brute(t)) for i, t in list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])])
    assert all(0 <= r.score <= 1 for r in got)


def test_many_places_of_one_text_take_linear_time(spark):
    texts = ["MIT License " * 200_000, "licensed under GPL. " * 60_000 + "x " * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    took = {}
    for places in (25_000, 25_000, 200_000):  # the first plans and compiles
        own = spark.createDataFrame([(0, "MIT License " * places)], DOCS)
        began = time.time()
        (mit,) = licenses.digest(licenses.scan(own)).collect()
        took[places] = time.time() - began
    assert took[200_000] < 24 * took[25_000]  # 8 times the places; the square would be 64 times
    (gpl,) = licenses.digest(licenses.scan(rows.where("doc_id = 1"))).collect()
    assert (mit.n_words, mit.n_base, mit.first_word, mit.last_word, mit.labels) == (400_000, 200_000, 0, 399_998, "mit")
    assert (gpl.n_words, gpl.n_base, gpl.first_word, gpl.labels) == (380_000, 0, None, "gpl")
    assert [r.n for r in licenses.scan(rows).orderBy("doc_id").select(F.size("detections").alias("n")).collect()] == [399_999, 119_999]  # "license mit" too


def test_grades_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    grades = ordinal.grades_of(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    held = grades.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0)
    model = ordinal.fit(docs, grades.join(held.select("doc_id"), "doc_id", "left_anti"))
    assert (np.diff(model.thresholds) > 0).all()
    rows = ordinal.grade(docs, model).join(held, "doc_id").collect()
    good = [r for r in rows if r.grade == 2]
    assert sum(r.keep for r in good) >= 0.97 * len(good)
    poor = [r for r in rows if r.grade == 0]
    assert sum(not r.keep for r in poor) >= 0.9 * len(poor)
    assert np.mean([abs(r.expected_grade - r.grade) for r in rows]) < 0.3


def test_grades_without_labels_keep_all(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumn("row", F.lit(1)).withColumn("keep", F.lit(2))
    none = spark.createDataFrame([(-1, None), (None, 1), (77, 2)], "doc_id long, grade int")
    model = ordinal.fit(docs, none)
    assert ordinal.grade(docs, model).where("keep").count() == len(ODD)
    model = ordinal.fit(docs, spark.createDataFrame([(-6, 0), (-3, 1)], "doc_id long, grade int"))
    assert ordinal.grade(docs, model).count() == len(ODD)
    assert ordinal.select(docs, model, 0.0).columns == docs.columns


def test_regression_orders_grades():
    rng = np.random.default_rng(1)
    ones = rng.random((600, 4)) < 0.5
    grade = (ones[:, 0].astype(int) + ones[:, 1]).clip(0, 2)
    row, column = np.nonzero(ones)
    weights, cuts = ordinal.regression(row, column, grade, 4)
    assert weights[0] > 1 and weights[1] > 1 and abs(weights[2]) < 0.8 and cuts[0] < cuts[1]


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())


def test_bpe_equals_library(spark, path):
    texts = ODD + [(i, "x" * 70 + f" {'yz' * 90} w{i % 3}") for i in range(10, 30)]
    tok, rows = tokenizer(path), spark.createDataFrame(texts, DOCS).withColumn("ids", F.lit(1)).withColumn("word", F.lit(2))
    for common in (10, 100_000):
        got = wordtable.digest(wordtable.decode_ids(wordtable.encode_texts(rows, path, common), path)).collect()
        assert Counter(map(tuple, got)) == Counter((i, *expected(tok, t)) for i, t in texts)
    assert wordtable.encode_texts(rows.limit(0), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t.,'!<|>1é 　́中\x1c\x85")), max_size=30))
def test_pieces_of_a_batch_are_those_of_each_text(text):
    from lakeaudit.llm.pieces import text_pieces

    for added in ([], ["<|endoftext|>"]):
        rows = [text, None, "", f"{text}<|endoftext|>{text}", "é<|endoftext|><|endoftext|> a", text]
        flat, counts = text_pieces(pa.array(["before", *rows, "after"]).slice(1, len(rows)), added)
        want = [cut(row or "", added) for row in rows]
        assert flat.to_pylist() == [p for w in want for p in w] and counts.tolist() == [len(w) for w in want]
    assert text_pieces(pa.array([], pa.string()), [])[0].to_pylist() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t.,'!<|>1é 　́中\x1c\x85")), max_size=30))
def test_pieces_encode_on_their_own(text):
    from lakeaudit.llm.pieces import default_path

    path = default_path()
    parts = cut(text, added_tokens(path))
    assert "".join(parts) == text
    assert sum(encode(path, parts), []) == tokenizer(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60), st.text(alphabet="ab '.\n<|endoftext|>", max_size=60)), max_size=6))
def test_edits_keep_counts(changes):
    from lakeaudit.llm.pieces import default_path

    path = default_path()
    encoder, added = Encoder(path), added_tokens(path)
    text = "It's a <|endoftext|> first, second  third\n" * 9
    parts = cut(text, added)
    tree = edits.Tree(np.array([len(p) for p in parts]), encoder.ids(parts)[1])
    for at, n, insert in changes:
        text, tree, again = edits.edit(text, tree, at, at + n, insert, encoder, added)
        assert tree.tokens == len(tokenizer(path).encode(text, add_special_tokens=False).ids)
        assert tree.sums[1, 0] == len(text) == tree.columns()[:, 0].sum()


def test_edit_table(spark, path):
    rows = spark.createDataFrame(ODD, DOCS)
    table = spark.createDataFrame([(-1, 1, 0, 5, "abc"), (-6, 2, 40, 90, None), (-6, 1, 7, 7, " x."), (99, 1, 0, 0, "?")],
                                  "doc_id long, number int, start long, stop long, insert string")
    got = edits.apply_edits(edits.with_edits(edits.build_trees(rows, path), table), path).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.tokens_after == len(tokenizer(path).encode(r.text, add_special_tokens=False).ids) == sum(r.leaf_tokens)
    long = next(r for r in got if r.doc_id == -6)
    assert long.n_edits == 2 and long.recounted < 300


def test_slots_are_a_permutation():
    for total in (1, 2, 3, 17, 1000, 4097):
        got = order.slots(np.arange(total), total, 5)
        assert sorted(got) == list(range(total))
    assert list(order.slots(np.arange(100), 100, 5)) != list(order.slots(np.arange(100), 100, 6))


def test_shards_hold_every_sequence(spark, path, tmp_path):
    rows = spark.createDataFrame([r for r in ODD if r[0] is not None], DOCS).withColumn("slot", F.lit(1))
    got = order.materialise(rows, path, str(tmp_path), key=3, length=64, shard_rows=100).collect()
    want = {}
    for i, t in ODD:
        ids = tokenizer(path).encode(t or "", add_special_tokens=False).ids
        want |= {(i, p): ids[p * 64 : p * 64 + 64] for p in range(-(-len(ids) // 64)) if i is not None}
    shards = {f.name: f.read_bytes() for f in tmp_path.iterdir() if not f.name.startswith((".", "_"))}
    read = {s: order.read_shard(d, 64) for s, d in shards.items()}
    assert {(r.doc_id, r.part): list(read[f"shard-{r.shard:08d}.bin"][r.slot % 100]) for r in got} == want
    assert sorted(r.slot for r in got) == list(range(len(want)))
    assert order.materialise(rows.limit(0), path, str(tmp_path / "none")).count() == 0
