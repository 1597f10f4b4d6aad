import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import kv
from lakeaudit.sources import sinks, tables

PAIRS = [(b"", b"e"), (b"a", b"1"), (b"ab", b"2"), (b"ab\xff", b"3"), (b"ac", b"4"),
         (b"b", b"5"), (b"\xff", b"6"), (b"\xff\xff", b"7"), (b"\x80z", b"8")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS[::-1], "key binary, value binary")


def keys(df):
    return [bytes(r.key) for r in df.collect()]


def test_scan_is_in_unsigned_byte_order(pairs):
    assert keys(kv.kv_scan(pairs)) == sorted(k for k, _ in PAIRS)


@pytest.mark.parametrize("prefix", [b"", b"a", b"ab", b"ab\xff", b"abc", b"\xff", b"\xff\xff", b"zz"])
def test_prefix(pairs, prefix):
    assert sorted(keys(kv.kv_prefix(pairs, prefix))) == sorted(k for k, _ in PAIRS if k.startswith(prefix))


def test_prefix_reaches_the_scan(spark, pairs, tmp_path):
    path = str(tmp_path / "kv")
    sinks.write_kv(pairs, path)
    plan = kv.kv_prefix(tables.read_kv(spark, path), b"ab")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan
    assert keys(tables.read_kv(spark, path).orderBy("key")) == sorted(k for k, _ in PAIRS)


def test_counts(pairs):
    assert kv.kv_count_contains(pairs, "b").first().n == 3
    kinds = {r.kind: r.n for r in kv.kv_group_count(pairs).collect()}
    assert kinds == {" ": 1, "a": 4, "b": 1, "\xff": 2, "\x80": 1}


def test_dump(spark, pairs, tmp_path):
    path = str(tmp_path / "dump")
    text = pairs.where("octet_length(key) < 2 and key < X'7f'")
    sinks.write_dump(text, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == [" = e", "a = 1", "b = 5"]


def test_map_kv(pairs):
    def lengths(batches):
        for pdf in batches:
            yield pdf.assign(n=pdf["key"].map(len))[["n"]]

    want = sorted(len(k) for k, _ in PAIRS)
    assert sorted(r.n for r in kv.map_kv(pairs, lengths, "n bigint").collect()) == want

    def in_arrow(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            n = pc.binary_length(batch.column(0)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([n], names=["n"])

    assert sorted(r.n for r in kv.map_kv(pairs, in_arrow, "n bigint", arrow=True).collect()) == want


@pytest.fixture(scope="module")
def entities(spark):
    at = [dt.datetime(2024, 1, d, h) for d, h in [(1, 0), (1, 23), (2, 0), (31, 12), (31, 12)]]
    rows = [("xy"[i % 2], i, t) for i, t in enumerate(at)]
    return spark.createDataFrame(rows, "entity_type string, entity_id bigint, start_ts timestamp_ntz")


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def test_seek(entities):
    out = [r.entity_id for r in kv.seek_desc(entities, ntz("2024-01-02 00:00:00")).collect()]
    assert out == [2, 1, 0]
    assert [r.entity_id for r in kv.seek_desc(entities, ntz("2024-02-01 00:00:00"), 2).collect()] == [4, 3]


def test_seek_by_reversed_key(spark, entities, tmp_path):
    path = str(tmp_path / "newest")
    old = spark.createDataFrame([("x", 9, dt.datetime(1960, 5, 5)), ("x", 8, dt.datetime(1970, 1, 1)), ("x", 7, None)], entities.schema)
    every = entities.unionByName(old)
    sinks.write_newest_first(every, path)
    stored = spark.read.parquet(path)
    assert [r.entity_id for r in stored.where("key is not null").orderBy("key", "entity_type", "entity_id").collect()] == [4, 3, 2, 1, 0, 8, 9]
    for moment in ("2024-01-02 00:00:00", "2024-02-01 00:00:00", "1965-01-01 00:00:00", "1900-01-01 00:00:00"):
        found = kv.seek_newest(stored, ntz(moment))
        want = [r.entity_id for r in kv.seek_desc(every, ntz(moment)).collect()]
        assert [r.entity_id for r in found.orderBy("key", "entity_type", "entity_id").collect()] == want
        assert [r.entity_id for r in kv.seek_newest(stored, ntz(moment), 2).collect()] == want[:2]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key" in plan and "Sort" not in plan and "Exchange" not in plan


def test_entities(entities):
    assert {r[0] for r in kv.entity_types(entities).collect()} == {"x", "y"}
    out = {r.entity_type: (r.kept, r.discarded) for r in kv.entity_ttl(entities, ntz("2024-01-02 00:00:00")).collect()}
    assert out == {"x": (1, 2), "y": (1, 1)}


def test_exact_day(entities):
    out = kv.on_exact_day(entities, "start_ts", F.to_date(F.lit("2024-01-31")), 30)
    assert sorted(r.entity_id for r in out.collect()) == [0, 1]
