"""The split forms for hot keys give the same rows as the plain ones."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeaudit.operators import lines, oplog, ordered, records
from lakeaudit.operators.ordered import in_blocks, ranked, running
from lakeaudit.operators.skew import hot_keys, salted_join


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(autouse=True)
def every_row_may_be_sampled(monkeypatch):
    """So that tables of some hundred rows are cut."""
    monkeypatch.setattr(ordered, "_ONE_IN", 1)


@pytest.fixture(scope="module")
def facts(spark):
    """Key 1 holds a third of the rows; some keys are NULL; positions are sparse."""
    rng = random.Random(5)
    rows = []
    for pos in rng.sample(range(-500, 40_000), 600):
        key = 1 if rng.random() < 0.34 else rng.choice([2, 3, 4, 5, None])
        rows.append((key, pos, rng.randrange(100)))
    return spark.createDataFrame(rows, "k bigint, pos bigint, v bigint").cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_salted_join(spark, facts, how, hot_rows):
    dims = spark.createDataFrame([(1, "one"), (3, "three"), (9, "nine")], "k bigint, name string")
    got = salted_join(facts, dims, "k", ["pos"], how, hot_rows)
    assert bag(got) == bag(facts.join(dims, "k", how).select(got.columns))


def test_hot_keys_are_few(facts):
    hot = {r._hot_key: r._parts for r in hot_keys(facts, "k", 150).collect()}
    assert set(hot) == {1} and hot[1] == -(-facts.where("k = 1").count() // 150)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("exclusive", [True, False])
@pytest.mark.parametrize("parts", [1, 7, 200])
def test_running(facts, keys, exclusive, parts):
    df = facts.where("k is not null")
    aggs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}
    got = running(df, keys, "pos", aggs, exclusive, parts).select("k", "pos", "s", "hi", "lo")
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("pos").rowsBetween(
        W.unboundedPreceding, -1 if exclusive else 0)
    want = df.select("k", "pos", F.coalesce(F.sum("v").over(w), F.lit(0)), F.max("v").over(w), F.min("v").over(w))
    assert bag(got) == bag(want)


def test_running_at_the_ends_of_bigint(spark):
    ids = [-(2**63), -(2**63) + 5, -1, 0, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = [r.n for r in ranked(df, [], "id", "n", 2).orderBy("id").collect()]
    assert got == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("parts", [1, 60])
def test_ranked_null_key(facts, parts):
    got = ranked(facts, ["k"], "pos", "n", parts).select("k", "pos", "n")
    want = facts.select("k", "pos", F.row_number().over(W.partitionBy("k").orderBy("pos")))
    assert bag(got) == bag(want)


@pytest.mark.parametrize("after", [0, 1, 2])
@pytest.mark.parametrize("broadcast_bytes", ["-1", "10485760"])
def test_grep_context(spark, after, broadcast_bytes):
    rng = random.Random(3)
    rows = [(f, i, rng.choice(["Hit me", "x", "y", "z"])) for f in "ab" for i in range(1, 60)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, line string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_bytes)
    try:
        got = {(r.file, r.line_no) for r in lines.grep_context(df, "hit", after).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    text = {(f, i): t for f, i, t in rows}
    want = {(f, i) for f, i, _ in rows
            if any("Hit" in text.get((f, j), "") for j in range(i - after, i + 1))}
    assert got == want


def test_grep_case(spark):
    df = spark.createDataFrame([("a", 1, "Hit"), ("a", 2, "hit")], "file string, line_no bigint, line string")
    assert [r.line_no for r in lines.grep_context(df, "hit", 0, ignore_case=False).collect()] == [2]


def final_plan(df):
    """The plan that ran, after a run."""
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    query.toRdd().count()
    return query.executedPlan().toString()


@pytest.fixture(scope="module")
def hot_table(spark, tmp_path_factory):
    """40,000 rows, a third of one key."""
    path = str(tmp_path_factory.mktemp("hot") / "t")
    n = F.col("id")
    key = F.when(n % 3 == 0, -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(500)))
    spark.range(40_000).select(key.cast("bigint").alias("k"), n.alias("pos"), (n % 97).alias("v")).repartition(6).write.parquet(path)
    return path


def test_a_scan_over_ordered_rows_reads_twice(spark, hot_table):
    """Once for the borders, once for the rows: totals come from the same exchange."""
    df = spark.read.parquet(hot_table)
    got = running(df, ["k"], "pos", {"s": ("sum", "v"), "m": ("max", "pos")})
    text = final_plan(got)
    final = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert final.count("Scan parquet") <= 2 and "ReusedExchange" in final
    w = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    assert got.exceptAll(df.withColumns({"s": F.sum("v").over(w), "m": F.max("pos").over(w)})).isEmpty()


@pytest.mark.parametrize("one_in", [1, 64])
def test_blocks_of_a_hot_key_are_small_and_few(spark, hot_table, monkeypatch, one_in):
    monkeypatch.setattr(ordered, "_ONE_IN", one_in)
    df = spark.read.parquet(hot_table)
    cut = in_blocks(df, ["k"], "pos", 32)
    sizes = cut.groupBy("k", "_block").agg(F.count("*").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 5 * 40_000 / 32
    assert 8 <= sizes.where("k = -1").count() <= 16 and sizes.where("_block is not null").count() <= 64
    assert cut.select(df.columns).exceptAll(df).isEmpty()


@pytest.mark.parametrize("parts", [1, 5, 100])
@pytest.mark.parametrize("n", [0, 5, 150, 5_000])
def test_tail(facts, n, parts):
    df = facts.where("k is not null").select(F.col("k").alias("file"), "pos", F.col("v").alias("value"))
    got = records.tail_n(df, n, parts)
    w = W.partitionBy("file").orderBy(F.desc("pos"))
    want = df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    assert bag(got.select("file", "pos", "value", "from_end")) == bag(want)


def test_a_tail_orders_only_the_last_blocks(spark, hot_table):
    df = spark.read.parquet(hot_table).select(F.col("k").alias("file"), "pos", F.col("v").alias("value"))
    cut, behind = records.from_end(df, 32)
    kept = cut.join(behind, ["file", "_block"]).where("file = -1 and _behind < 300")
    assert 300 <= kept.count() <= 300 + 5 * 40_000 / 32
    assert records.tail_n(df, 300, 32).where("file = -1").agg(F.min("from_end"), F.max("from_end"), F.count("*")).first()[:] == (1, 300, 300)


@pytest.mark.parametrize("parts", [1, 40])
def test_failing_records(facts, parts):
    df = facts.where("k is not null").select(F.col("k").alias("file"), "pos", F.when(F.col("v") < 30, F.col("pos")).otherwise(F.col("v")).alias("value"))
    w = W.partitionBy("file").orderBy(F.desc("pos"))
    want = df.withColumn("t", F.row_number().over(w) <= 9).withColumn("s", records.in_sample(4)).where("value <> pos")
    got = records.verified(df, 9, 4, parts)
    assert bag(got) == bag(want) and {r.in_tail for r in got.collect()} == {True, False} == {r.in_sample for r in got.collect()}


def oplog_rows(spark, seed=1):
    rng = random.Random(seed)
    rows, event = [], 0
    for worker, count in [(1, 95), (2, 7), (3, 30), (8, 1)]:
        for seq in range(1, count + 1):
            event += 1
            rows.append((worker, seq, rng.choice("rw"), rng.randrange(50), rng.randrange(1, 4)))
    schema = "worker bigint, seq bigint, op string, elapsed bigint, items bigint"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("parts", [1, 30])
@pytest.mark.parametrize("every", [1, 10])
def test_running_max(spark, every, parts):
    log = oplog_rows(spark)
    w = W.partitionBy("worker").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    want = log.select("worker", "seq", F.count("*").over(w), F.max("elapsed").over(w)).where(F.col("seq") % every == 0)
    assert bag(oplog.running_max(log, every, parts)) == bag(want)


@pytest.mark.parametrize("parts", [1, 30])
def test_running_total(spark, parts):
    got = oplog.running_total(oplog_rows(spark), parts).orderBy("seq").collect()
    before = 0
    for row in got:
        assert row.items_before == before
        before += row["items"]
        assert row.items_after == before


@pytest.mark.parametrize("parts", [1, 30])
def test_id_gap(spark, parts):
    ids = [10, 11, 15, 40, 1000]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert bag(oplog.id_gap(df, "id", parts=parts)) == bag(
        spark.createDataFrame([(10, None), (11, 1), (15, 4), (40, 25), (1000, 960)], "id bigint, gap bigint"))
    first = oplog.id_gap(df, "id", start=8, parts=parts).where("id = 10").first()
    assert first.gap == 2


@pytest.mark.parametrize("parts", [1, 30])
def test_mode_split(spark, parts):
    out = {r["mode"]: r for r in oplog.mode_split(oplog_rows(spark), 0.5, parts).collect()}
    assert out["read"].workers == 2 and out["write"].workers == 2
    log = oplog_rows(spark).where("worker in (1, 2)")
    want = log.agg(F.sum("items"), F.sum("elapsed")).first()
    assert (out["read"]["items"], out["read"].elapsed) == tuple(want)
    none = {r["mode"]: r for r in oplog.mode_split(oplog_rows(spark), 0.0, parts).collect()}
    assert none["read"].workers == 0 and none["read"].per_sec is None
