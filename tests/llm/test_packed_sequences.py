"""Between op4's stages sequences lie packed together, and every record still comes to its slot."""

import random

from pyspark.sql import functions as F

from lakeaudit.llm import order
from lakeaudit.llm.pieces import tokenizer
from tests.llm.test_pairs import some_words


def test_sequences_are_packed_and_every_shard_is_whole(spark, path, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i if i % 7 else None, some_words(rng, rng.randint(0, 300)) if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, real = [], order.stored
    monkeypatch.setattr(order, "stored", lambda df, name: seen.append(real(df, name)) or seen[-1])
    monkeypatch.setattr(order, "BUCKET_SHARDS", 3)
    got = order.materialise(docs, path, str(tmp_path), length=32, shard_rows=50).collect()
    want = sorted(tuple(ids[a : a + 32]) for _, t in rows for ids in [tokenizer(path).encode(t or "", add_special_tokens=False).ids] for a in range(0, len(ids), 32))
    shards = sorted(f for f in tmp_path.iterdir() if not f.name.startswith((".", "_")))
    read = [tuple(r.tolist()) for f in shards for r in order.read_shard(f.read_bytes(), 32)]
    assert sorted(read) == want and len(shards) == -(-len(want) // 50)
    assert sorted((r.slot, r.shard, r.offset, r.n_tokens) for r in got) == [(s, s // 50, s % 50 * 68, len(ids)) for s, ids in enumerate(read)]
    stored, packed = seen[0].agg(F.count("*"), F.sum(F.octet_length("ids"))).first()
    assert stored < len(want) / 10 and packed < 0.8 * 2 * sum(map(len, want))
