"""Operation logs, run series, lines and records on literal rows."""

import datetime as dt

import pytest

from lakeaudit.operators import lines, oplog, records, runs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rows = [  # worker, seq, op, start, elapsed, gc, items
        (1, 1, "w", T0, 500, 100, 10),
        (1, 2, "w", T0 + dt.timedelta(seconds=1), 900, 0, 10),
        (2, 1, "w", T0 + dt.timedelta(seconds=2), 900, 300, 20),
        (2, 2, "r", T0, 0, 0, 5),
    ]
    schema = ("worker bigint, seq bigint, op string, start_ts timestamp_ntz, elapsed bigint, "
              "gc bigint, items bigint")
    return spark.createDataFrame(rows, schema)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_min_max_total(log):
    out = by(oplog.min_max_total(log), "op")["w"]
    assert (out.calls, out.min_elapsed, out.max_elapsed, out.total_elapsed) == (3, 500, 900, 2300)
    assert out.span_us == 2_900_000


def test_slowest_takes_the_first_of_equals(log):
    out = by(oplog.slowest(log), "op")
    assert (out["w"].worker, out["w"].seq, out["w"].elapsed) == (1, 2, 900)
    assert out["w"].start_ts == T0 + dt.timedelta(seconds=1)


def test_throughput(log):
    out = by(oplog.throughput(log), "op")
    assert out["w"].per_sec == pytest.approx(40 / (2.3 / 2))
    assert out["r"].per_sec is None


def test_batches(log):
    out = {(r.worker, r.batch): (r.calls, r.elapsed) for r in oplog.batch_time(log, 2).collect()}
    assert out == {(1, 0): (2, 1400), (2, 0): (2, 900)}
    assert oplog.batch_time(log, 1).count() == 4


def test_gc_and_cpu(log):
    assert by(oplog.gc_adjusted(log), "seq")[1].net == 1000
    out = by(oplog.cpu_usage(log), "op")
    assert out["w"].usage_pct == pytest.approx(100 * 400 / 2300) and out["r"].usage_pct is None


def test_milestones(spark, log):
    many = spark.range(1, 1001).selectExpr("1L as worker", "id as seq")
    assert sorted(r.seq for r in oplog.milestones(many).collect()) == [1, 10, 100, 1000]


def test_mask_bucket(spark):
    ids = spark.createDataFrame([(-1,), (0,), (15,), (16,)], "id bigint")
    out = {r.block_start: (r.n, r.next_start) for r in oplog.mask_bucket(ids, "id").collect()}
    assert out == {-16: (1, 0), 0: (2, 16), 16: (1, 32)}


def test_ab_compare(spark):
    rows = [("s", 1, "before", 10), ("s", 1, "before", 20), ("s", 1, "after", 30), ("t", 1, "before", 5)]
    df = spark.createDataFrame(rows, "suite string, level int, phase string, value bigint")
    out = by(runs.ab_compare(df), "suite")
    assert (out["s"].before, out["s"].after, out["s"].delta, out["s"].ratio) == (15.0, 30.0, 15.0, 2.0)
    assert out["t"].after is None and out["t"].ratio is None


def test_human_sizes(spark):
    df = spark.createDataFrame([("g", "1KB", "1s"), ("g", "1", "30m"), ("g", "x", "?")], "g string, s string, t string")
    row = runs.human_size_rollup(df, "g", "s", "t").first()
    assert (row.bytes, row.millis, row.size_txt, row.time_txt) == (1025, 1_801_000, "1.00 KB", "30.02 分钟")


@pytest.fixture(scope="module")
def reports(spark):
    rows = [("a", 1, "Live datanodes (3):"), ("a", 2, "Live datanodes (9):"), ("b", 1, "x"),
            ("c", 1, "see Live datanodes (3):"), ("c", 2, "Live datanodes none"), ("d", 5, "Live datanodes (2) of 7")]
    return spark.createDataFrame(rows, "file string, line_no bigint, line string")


def test_reports(reports):
    found = lines.report_extract(reports, "Live datanodes")
    assert {r.file: r.observed for r in found.collect()} == {"a": 3, "b": None, "c": None, "d": 2}
    gate = lines.health_gate(found, 3)
    assert {r.file: r.ok for r in gate.collect()} == {"a": True, "b": False, "c": False, "d": False}
    with pytest.raises(RuntimeError):
        lines.require_healthy(gate)
    lines.require_healthy(gate.where("file = 'a'"))


def test_comments(spark):
    rows = [("h", 1, "# note"), ("h", 2, "host1"), ("h", 3, " # kept"), ("h", 4, "")]
    df = spark.createDataFrame(rows, "file string, line_no bigint, line string")
    assert [r.line_no for r in lines.drop_comments(df).collect()] == [2, 3, 4]


def test_records(spark):
    rows = [("f", p, p if p != 24 else 0) for p in range(0, 800, 8)]
    df = spark.createDataFrame(rows, "file string, pos bigint, value bigint")
    assert [r.pos for r in records.record_verify(df).collect()] == [24]
    once = sorted(r.pos for r in records.sampled(df, 4).collect())
    assert once == sorted(r.pos for r in records.sampled(df.repartition(7), 4).collect())
    assert 0 < len(once) < 100
