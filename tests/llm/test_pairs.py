"""Top-k, near-duplicates, decontamination, byte repeats and the pipeline against brute force."""

import random
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lakeaudit.llm import components, contamination, induced, jaccard, ordinal, repeats, topk
from tests.llm import brute

DOCS = "doc_id long, text string"


def some_words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def texts():
    """Copies, near copies of every degree, shared passages, empty, short and long texts."""
    rng = random.Random(3)
    base = [some_words(rng, 120) for _ in range(4)]
    out = [None, "", "!!", "one two", "One, two!", "x" * 900, "ab " * 400, "é" * 600, some_words(rng, 9_000)]
    for b in base:
        out += [b, b, b.upper()]
        own = b.split()
        for changes in (1, 2, 3, 4, 6, 9, 20):
            new = own[:]
            for at in rng.sample(range(len(own)), changes):
                new[at] = some_words(rng, 1)
            out.append(" ".join(new))
    passage = some_words(rng, 90)
    out += [some_words(rng, 40) + " " + passage + " " + some_words(rng, 40) for _ in range(6)]
    return dict(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("rep", F.lit(1)).withColumn("value", F.lit("clash"))


def test_topk_with_ties_and_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-3, 3) / 8 for _ in range(4)]) for i in range(200)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]
    rows += [(i, v) for i, v in rows[:3]]  # repeated rows
    odd = [(5000, None), (5050, [1.0, None, 2.0, 3.0]), (5100, [float("nan")] * 4), (5150, [float("inf")] * 4), (None, [1.0] * 4), (5200, [1e300] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(0))
    own = topk.usable(df, "vec_id", "embedding")
    got = topk.top_k(own, own.where("vec_id % 50 = 0 and vec_id < 5000"), 5, query_block=3).collect()
    vectors = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows + [odd[-1]]]
    want = []
    for q in sorted({i for i, _ in vectors if i % 50 == 0 and i < 5000}):
        mine = next(v for i, v in vectors if i == q)
        scores = sorted((-min(max(sum(a * b for a, b in zip(mine, v)), -2**63), 2**63 - 1), i) for i, v in vectors if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(own, own.where("false"), 5).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    own = texts()
    rows = [*own.items(), (None, own[9])]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.ngram_jaccard_join(frame(spark, rows)).collect()}
    assert got == brute.near(own)
    assert jaccard.ngram_jaccard_join(frame(spark, rows).limit(0)).count() == 0


def test_large_near_group_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = some_words(rng, 100).split()
    own = {}
    for i in range(90):
        new = base[:]
        new[rng.randrange(100)] = some_words(rng, 1)
        own[i] = " ".join(new)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.ngram_jaccard_join(frame(spark, list(own.items()))).collect()}
    assert got == brute.near(own)


def test_pruning_bounds():
    bounds = jaccard.least_matches(0.8)
    assert all(0 < m < 0.8 * n for n, m in bounds.items() if n >= 64)
    assert list(bounds.values()) == sorted(bounds.values())


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {i: 0 for i in range(1, 61)} | {101: 100}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = {i: some_words(rng, n) for i, n in enumerate((5, 6, 9, 14, 30, 59, 200))}
    items |= {20: items[3], 21: None, 22: "", 23: "two words"}
    docs = {100: None, 101: "", 102: "Two, words!", 103: some_words(rng, 3_000)}
    for n, i in enumerate(range(7)):
        own = items[i].split()
        docs[n] = some_words(rng, 2_000) + " " + items[i].upper() + ". " + some_words(rng, 700)
        docs[200 + n] = some_words(rng, 50) + " " + " ".join(own[: len(own) * 2 // 3]) + " " + some_words(rng, 50)
        docs[300 + n] = " ".join(own[: len(own) * 19 // 20]) + " " + some_words(rng, 5)
    given_items = spark.createDataFrame([*items.items(), (None, items[4])], "item_id long, text string").withColumn("name", F.lit(1))
    rows = [*docs.items(), *list(docs.items())[:5], (None, docs[3])]
    got = contamination.contaminated(frame(spark, rows), given_items).collect()
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == brute.leaks(docs, items) and len(got) == len(brute.leaks(docs, items))
    assert {r.item_id: r.n_items for r in got}[3] == 2
    assert contamination.contaminated(frame(spark, rows), given_items.limit(0)).count() == 0


def test_no_short_item_is_lost(spark):
    rng = random.Random(6)
    items = {i: some_words(rng, 5 + i % 2) for i in range(900)}
    docs = {n: " ".join([some_words(rng, rng.randint(0, 30)) + " " + items[i] for i in range(n, 900, 60)]) for n in range(60)}
    given_items = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = contamination.contaminated(frame(spark, list(docs.items())), given_items).collect()
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == brute.leaks(docs, items)


def test_sketches_of_long_items_lose_none(spark):
    rng = random.Random(16)
    items = {i: some_words(rng, rng.choice((35, 36, 50, 90, 200, 500, 1_500))) for i in range(80)}
    docs = {}
    for i in items:
        own = items[i].split()
        for _ in range(len(own) // 32):  # about the least share that counts
            own[rng.randrange(len(own))] = "changed"
        docs[i] = some_words(rng, rng.randint(0, 2_000)) + " " + " ".join(own) + " " + some_words(rng, rng.randint(0, 900))
    docs[500] = " ".join(items.values())
    given_items = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = contamination.contaminated(frame(spark, list(docs.items())), given_items).collect()
    want = brute.leaks(docs, items)
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == want and len(want) > 100
    own = np.sort(np.random.default_rng(2).integers(0, 2**63, 4_000).astype(np.uint64))
    least = contamination._least(own)
    assert len(np.intersect1d(own, least)) == contamination.BINS and contamination._sketched(own, np.arange(4_000), 8).sum() < 2_500


def test_texts_of_one_id_are_judged_alone(spark):
    rng = random.Random(17)
    item, clean = some_words(rng, 60), some_words(rng, 80)
    half = item.split()
    rows = [(1, " ".join(half[:30])), (1, " ".join(half[30:])), (2, clean), (2, item), (2, item), (3, clean)]
    given_items = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = contamination.contaminated(frame(spark, rows), given_items).collect()
    assert [(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got] == [(2, 9, 56, 56)]


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(1, k * k), max_size=70)), st.sampled_from([2, 30, 1 << 20]))
def test_suffixes_in_order(tmp_path_factory, numbers, most):
    text = np.array([*numbers, 0], np.int32)
    got = induced.suffix_array(text, str(tmp_path_factory.mktemp("q")), most)
    assert list(got) == sorted(range(len(text)), key=lambda i: list(text[i:]))


def test_queues_leave_nothing_behind(tmp_path):
    text = np.array([*np.random.default_rng(0).integers(1, 5, 4_000), 0], np.int32)
    got = induced.suffix_array(text, str(tmp_path), most=50)
    assert list(got) == sorted(range(len(text)), key=lambda i: text[i:].tobytes() if False else list(text[i:]))
    assert not list(tmp_path.iterdir())


def test_byte_repeats_equal_brute_force(spark):
    rows = [*texts().items(), (None, "x" * 401), (-5, "y" * 399), (-6, "y" * 400), (3, "one two"), (9, texts()[9])]
    for length, shard in ((400, 1 << 22), (200, 5_000)):
        got = repeats.digest(repeats.remove_repeats(frame(spark, rows), length, most=500, shard=shard)).collect()
        want = brute.cut_repeats([(t or "").encode() for _, t in rows], length)
        import hashlib

        assert Counter(map(tuple, got)) == Counter(
            (i, len((t or "").encode()), n, spans, hashlib.sha256(kept).hexdigest()) for (i, t), (kept, n, spans) in zip(rows, want)
        )
    assert repeats.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_no_sort_holds_a_common_passage_of_all_documents(spark, monkeypatch):
    rng = random.Random(12)
    passage, edge = some_words(rng, 130), some_words(rng, 12)
    rows = [(i, some_words(rng, rng.randint(0, 90)) + " " + (edge if i % 3 == 0 else "") + passage + some_words(rng, 60)) for i in range(150)]
    rows += [(i, rows[i][1]) for i in range(3)]
    rows += [(200 + i, rows[i][1][100:900] + some_words(rng, 9)) for i in range(4)]
    shard, real = 10_000, repeats._shards

    def bounded(length, folder, most, shard):
        own = real(length, folder, most, shard)

        def run(batches):
            sizes = {}

            def watched():
                for batch in batches:
                    for anchor, content in zip(batch.column("anchor").to_pylist(), batch.column("content").to_pylist()):
                        sizes[anchor] = sizes.get(anchor, 0) + len(content)
                        assert sizes[anchor] <= shard, "all segments of an anchor in one task"
                    yield batch

            return own(watched())

        return run

    monkeypatch.setattr(repeats, "_shards", bounded)
    for length in (400, 201):
        got = repeats.remove_repeats(frame(spark, rows), length, most=500, shard=shard).collect()
        want = brute.cut_repeats([t.encode() for _, t in rows], length)
        assert Counter((r.doc_id, bytes(r.kept), len(r.spans)) for r in got) == Counter((i, kept, spans) for (i, _), (kept, _, spans) in zip(rows, want))


def test_pipeline_stages_equal_brute_force(spark, sf, path=None):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][1:4] == ["n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination"]
    before = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    classes = brute.near(before)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in classes.items() if i == c)
    cut = {r.doc_id: r for r in corpus_pipeline.byte_repeats(spark, docs, sf).collect()}
    want = brute.cut_repeats([(t or "").encode() for t in before.values()], repeats.LENGTH)
    for (i, t), (left, n, _) in zip(before.items(), want):
        assert cut[i].text == (left.decode("utf-8", "ignore") if n else t) and cut[i].n_chars == len(cut[i].text)
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf).collect()}
    assert clean == set(before) - {d for d, _, _ in brute.leaks(before, items)}
    graded = corpus_pipeline.quality(spark, docs, sf)
    assert graded.columns == docs.columns and 0 < graded.count() < len(before)


def test_pipeline_on_odd_rows(spark, sf):
    rows = [(None, "a b", "en", "s", 3), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, "w " * 3_000, "en", "s", 6_000)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 4


def test_equal_rows_of_one_id_cost_no_more_than_different_ones(spark):
    """Every place of an equal row is named once, however many there are."""
    text = some_words(random.Random(12), 500)
    df = spark.range(2_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    took = []
    for rows in (df.withColumn("doc_id", F.monotonically_increasing_id()), df):
        start = time.time()
        found = repeats.outcome(repeats.remove_repeats(rows)).agg(F.count("*"), F.sum("n_removed"), F.max("bytes_left")).first()
        took.append(time.time() - start)
        assert tuple(found) == (2_000, 2_000 * len(text), 0)
    assert took[1] < 1.5 * took[0] + 2


def test_copies_of_a_labelled_row_do_not_weigh(spark):
    """The fit sees one text of each id, so the model is that without copies; scores equal a plain restatement."""
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(["good", "fine", "plain"] if i % 2 else ["bad", "poor", "plain"]) for _ in range(20))) for i in range(120)]
    grades = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, grade int")
    once = spark.createDataFrame(rows, DOCS)
    copies = once.unionByName(once.where("doc_id = 3").crossJoin(spark.range(3_000)).select("doc_id", F.concat("text", F.lit(" zzz")).alias("text")))
    one, other = ordinal.fit(once, grades), ordinal.fit(copies, grades)
    assert np.array_equal(one.hashes, other.hashes) and np.allclose(one.weights, other.weights) and len(one.hashes) > 3
    weight = dict(zip(one.hashes.tolist(), one.weights))
    for r in ordinal.grade(once, one).collect():
        found = set()
        for w in dict(rows)[r.doc_id].split():
            found |= {ordinal._hash("w:" + w)} | ({ordinal._hash("p:" + w[:4])} if len(w) > 4 else set())
        own = dict(rows)[r.doc_id].split()
        again = sum(w in own[max(i - 2, 0) : i] for i, w in enumerate(own)) / len(own)
        found |= {ordinal._hash(f"again:{int(again * 10)}"), ordinal._hash("upper:0"), ordinal._hash("symbol:0")}
        s = sum(weight.get(h, 0) for h in found)
        assert abs(r.p_top - 1 / (1 + np.exp(one.thresholds[-1] - s))) < 1e-9
