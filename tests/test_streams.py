import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeaudit.streaming import paced, streams

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "worker bigint, op string, start_ts timestamp_ntz, elapsed bigint"


def write(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def source(spark, path, schema=SCHEMA, **limits):
    parsed = spark.createDataFrame([], schema).schema
    return streams.read_files(spark, path, parsed, **limits)


def test_rollup_closes_windows_and_drops_late_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))

    def drain():
        streams.drain_append(streams.op_rollup(source(spark, src)), out, state)
        return {(r.window_start, r.op): (r.n, r.max_elapsed) for r in spark.read.parquet(out).collect()}

    write(spark, src, [(1, "a", at(1), 5), (1, "a", at(9), 7), (1, "b", at(2), 1), (1, "a", at(31), 2)])
    first = {(at(0), "a"): (2, 7), (at(0), "b"): (1, 1)}
    assert drain() == first
    # A late row for a closed window, and rows that close the next one. Also a restart.
    write(spark, src, [(1, "a", at(3), 99), (1, "a", at(60), 4)])
    assert drain() == first | {(at(30), "a"): (1, 2)}


def test_rollup_equals_batch_when_nothing_is_late(spark, sf, tmp_path):
    from lakeaudit.plans import views as V

    events = V.table(spark, sf, "events")
    last = events.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.lit(at(10**8)).cast("timestamp_ntz"))
    src = str(tmp_path / "in")
    events.unionByName(last).coalesce(1).write.parquet(src)
    stream = streams.read_files(spark, src, events.schema)
    out = str(tmp_path / "out")
    streams.drain_append(streams.op_rollup(V.op_events(stream)), out, str(tmp_path / "state"))
    batch = streams.op_rollup(V.op_events(events))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


def test_worker_max_survives_a_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for rows in ([(1, "a", at(0), 5), (2, "a", at(0), 9)], [(1, "b", at(1), 3), (1, "b", at(2), 8)]):
        write(spark, src, rows)
        streams.drain_updates(streams.worker_max(source(spark, src)), out, state)
    got = {r.worker: (r.calls, r.max_elapsed) for r in streams.latest_worker_max(spark, out).collect()}
    assert got == {1: (3, 8), 2: (1, 9)}


def test_alerts_do_not_depend_on_the_cut(spark, tmp_path):
    schema = "parent string, name string"
    rows = [("d", "a"), ("d", "b"), ("e", "x"), ("f", "1"), ("f", "2"), ("f", "3"), ("g", "p"), ("g", "q")]
    got = []
    for files in (1, 4, 8):
        src, out = str(tmp_path / f"in{files}"), str(tmp_path / f"out{files}")
        for k in range(files):
            write(spark, src, rows[k::files], schema)
        stream = source(spark, src, schema, max_files=1)
        streams.drain_expect_alert(stream, 2, out, out + "-state", stop=False, hot_rows=1)
        got.append(sorted(map(tuple, streams.alerts(spark, out).collect())))
    assert got[0] == got[1] == got[2] == [("e", 1, "x"), ("f", 3, "1"), ("f", 3, "2"), ("f", 3, "3")]


def test_alert_stops_the_query(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "parent string, name string"
    write(spark, src, [("d", "a"), ("d", "b")], schema)

    def drain(name):
        out = str(tmp_path / name)
        try:
            streams.drain_expect_alert(source(spark, src, schema, max_files=1), 2, out, out + "-state", hot_rows=1)
        finally:
            assert sorted(map(tuple, streams.alerts(spark, out).collect())) == want

    want = []
    drain("fine")
    for rows, want in (([("e", "x")], [("e", 1, "x")]), ([("e", "y"), ("e", "z")], [("e", 3, c) for c in "xyz"])):
        write(spark, src, rows, schema)
        with pytest.raises(streams.LayoutAlert):
            drain(f"stopped{len(want)}")


def test_streams_without_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [])
    out = str(tmp_path / "out")
    streams.drain_updates(streams.worker_max(source(spark, src)), out, str(tmp_path / "state"))
    assert streams.latest_worker_max(spark, out).count() == 0


def test_rollup_of_files_in_time_order(spark, tmp_path):
    rows = [(1, "ab"[i % 2], at(3 * i), i) for i in range(64)]
    got = []
    for files in (1, 4, 16):
        src, out = str(tmp_path / f"in{files}"), str(tmp_path / f"out{files}")
        for k in range(files):
            write(spark, src, rows[k * 64 // files : (k + 1) * 64 // files])
        streams.drain_updates(streams.op_rollup(source(spark, src, max_files=1)), out, out + "-state")
        got.append(sorted(map(tuple, streams.latest_rollup(spark, out).collect())))
    log = spark.createDataFrame(rows, SCHEMA)
    assert got[0] == got[1] == got[2] == sorted(map(tuple, streams.op_rollup(log).collect()))


def test_throttled_read_takes_one_file_per_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(4):
        write(spark, src, [(i, "a", at(i), i)])
    stream = source(spark, src, max_files=1).withColumn("n", F.lit(1))
    out = str(tmp_path / "out")
    streams.drain_updates(stream.groupBy("worker").count(), out, str(tmp_path / "state"))
    rows = spark.read.parquet(out)
    assert rows.count() == 4 and rows.select("batch").distinct().count() == 4
    sized = source(spark, src, max_bytes="1")
    streams.drain_append(sized, str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 4


def test_late_rows_and_rollup_hold_every_row(spark, tmp_path):
    src, out, own = (str(tmp_path / d) for d in ("in", "out", "own"))
    bunches = [
        [(1, "a", at(1), 5), (1, "a", at(9), 7), (1, "b", at(2), 1), (1, "a", at(31), 2)],
        [(1, "a", at(3), 99), (1, "a", at(15), 8), (1, "a", at(60), 4), (2, "c", None, 6), (1, "a", at(3), 99)],
        [],
        [(1, "b", at(45), 3), (1, "a", at(29), 1), (1, "a", at(70), None)],
    ]
    for rows in bunches:
        write(spark, src, rows)
        streams.drain_rollup_with_late(source(spark, src), out, out + "-state")
        streams.drain_append(streams.op_rollup(source(spark, src)), own, own + "-state")
    late = streams.late_rows(spark, out)
    got = sorted((r.op, r.start_ts, r.elapsed) for r in late.where("start_ts is not null").collect())
    # 21 seconds are closed when the second bunch comes, 50 when the last one comes
    assert got == [("a", at(3), 99), ("a", at(3), 99), ("a", at(15), 8), ("a", at(29), 1), ("b", at(45), 3)]
    assert late.where("start_ts is null").count() == 1 and late.columns == ["worker", "op", "start_ts", "elapsed", "batch"]
    rolled = {(r.window_start, r.op): (r.n, r.max_elapsed) for r in streams.rollup_with_late(spark, out).collect()}
    assert rolled == {(at(0), "a"): (2, 7), (at(0), "b"): (1, 1), (at(30), "a"): (1, 2), (at(60), "a"): (1, 4), (at(70), "a"): (1, None)}
    # Spark's own watermark drops the same rows from the windows it has closed
    closed = {(r.window_start, r.op): (r.n, r.max_elapsed) for r in spark.read.parquet(own).collect()}
    assert closed and all(rolled[k] == v for k, v in closed.items())
    assert sum(n for n, _ in rolled.values()) + late.count() == sum(map(len, bunches))


def test_paced_read_reads_so_many_bytes_a_trigger(spark, tmp_path):
    root, out = tmp_path / "files", str(tmp_path / "out")
    root.mkdir()
    sizes = {"a": 1, "b": 10, "c": 25, "d": 0, "e": 30}
    for name, size in sizes.items():
        (root / name).write_bytes(b"x" * size)
    (root / "e").write_bytes(b"x" * 12)  # shorter than listed
    files = spark.createDataFrame([*sizes.items(), ("gone", 15), ("unknown", None)], "path string, length bigint")
    stream = paced.paced_read(spark, str(root), files, 10, parts=3)
    paced.drain(stream, out, out + "-state")
    rows = sorted((r.path, r.batch, r.start, r.length) for r in spark.read.parquet(out).collect())
    assert rows == [
        ("a", 0, 0, 1), ("b", 0, 0, 10), ("c", 0, 0, 10), ("c", 1, 10, 10), ("c", 2, 20, 5),
        ("e", 0, 0, 10), ("e", 1, 10, 2), ("e", 2, 20, 0), ("gone", 0, 0, None), ("gone", 1, 10, None),
    ]
    totals = {r.path: (r.length, r.triggers, r.most) for r in paced.paced_totals(spark, out).collect()}
    assert totals["c"] == (25, 3, 10) and totals["e"] == (12, 3, 10)
    with pytest.raises(ValueError):
        paced.paced_read(spark, str(root), files, 0)


def test_paced_read_goes_on_after_a_restart(spark, tmp_path):
    root, out = tmp_path / "files", str(tmp_path / "out")
    root.mkdir()
    (root / "a").write_bytes(b"x" * 45)
    files = spark.createDataFrame([("a", 45)], "path string, length bigint")
    for rows in (0, 1):
        seen = []

        def write(batch, number):
            if rows == 0 and number == 2:
                raise RuntimeError("lost")
            seen.extend((number, r.start, r.length) for r in batch.collect())

        query = paced.paced_read(spark, str(root), files, 10).writeStream.foreachBatch(write)
        query = query.option("checkpointLocation", out + "-state").start()
        try:
            query.processAllAvailable()
        except Exception as e:
            assert "lost" in str(e)
        finally:
            query.stop()
        assert seen == ([(0, 0, 10), (1, 10, 10)] if rows == 0 else [(2, 20, 10), (3, 30, 10), (4, 40, 5)])


def test_paced_read_of_no_file(spark, tmp_path):
    (tmp_path / "files").mkdir()
    out = str(tmp_path / "out")
    files = spark.createDataFrame([], "path string, length bigint")
    paced.drain(paced.paced_read(spark, str(tmp_path / "files"), files, 10), out, out + "-state")
    assert paced.paced_totals(spark, out).count() == 0
