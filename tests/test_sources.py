import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeaudit.sources import listing, manifests, sinks, tables


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, size in [("top.txt", 3), ("a/x", 10), ("a/b/c/deep", 0), ("a/b/.h", 1), ("z/x", 5)]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"x" * size)
    (root / "empty/inner").mkdir(parents=True)
    return str(root)


def walked(root):
    out = {("", True, 0)}
    for base, dirs, files in os.walk(root):
        rel = os.path.relpath(base, root)
        rel = "" if rel == "." else rel + "/"
        out |= {(rel + d, True, 0) for d in dirs}
        out |= {(rel + f, False, os.path.getsize(os.path.join(base, f))) for f in files}
    return out


@pytest.mark.parametrize("tasks", [1, 2, 64])
def test_fs_listing(spark, tree, tasks):
    rows = listing.fs_listing(spark, tree, tasks).collect()
    assert {(r.path, r.is_dir, r.length) for r in rows} == walked(tree) and len(rows) == len(walked(tree))
    assert {r.path: (r.parent, r.name) for r in rows}["a/b/.h"] == ("a/b", ".h")
    mtime = {r.path: r.mtime for r in rows}["a/x"]
    assert abs(mtime.timestamp() - os.path.getmtime(f"{tree}/a/x")) < 1


def test_list_tree(spark, tree):
    rows = listing.list_tree(spark, "file://" + tree).collect()
    assert {(r.path, r.is_dir, r.length) for r in rows} == walked(tree) and len(rows) == len(walked(tree))
    assert all(r.listed for r in rows)


def test_roots(spark, tree):
    assert listing.qualified(spark, tree).startswith("file:/")
    for root in (tree, "file:" + tree, "file://" + tree):
        assert listing.open_root(root)[1] == tree


def test_a_directory_that_vanishes_is_skipped(tree):
    fs, base = listing.open_root(tree)
    assert list(listing._children(fs, base, "no/such")) == []


def test_an_unreadable_directory_is_marked(spark, tmp_path, monkeypatch):
    """The walk goes on; a name that no task may open stands in for missing rights."""
    (tmp_path / "closed").mkdir()
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "x").write_text("x")
    real = listing._infos

    def refuses(fs, where):
        if where.endswith("closed"):
            raise PermissionError(where)
        return real(fs, where)

    monkeypatch.setattr(listing, "_infos", refuses)
    fs, base = listing.open_root(str(tmp_path))
    with pytest.raises(PermissionError):
        list(listing._children(fs, base, "closed"))
    assert {r[0] for r in listing._children(fs, base, "open")} == {"open/x"}


def test_children_pass_in_batches(tmp_path, monkeypatch):
    """A directory is never held whole: rows are taken as they are asked for."""
    taken = []

    def many(fs, where):
        for i in range(1_000_000):
            taken.append(i)
            yield f"f{i}", False, i, None

    monkeypatch.setattr(listing, "_infos", many)
    batch = next(listing._batches(listing._children(None, "/r", "d")))
    assert batch.num_rows == len(taken) == listing._BATCH
    assert batch.column("path")[7].as_py() == "d/f7"


def test_the_folder_of_the_given_tables(spark, sf):
    """Names, lengths and times of real files, as another engine sees them."""
    want = duckdb.sql(f"select parse_filename(filename) as name, size, epoch(last_modified) from read_blob('{sf}/*')").fetchall()
    for found in (listing.list_tree(spark, sf), listing.fs_listing(spark, sf, 4)):
        rows = found.where("not is_dir").select("path", "length", F.unix_micros("mtime").alias("at")).collect()
        assert sorted((r.path, r.length) for r in rows) == sorted((n, size) for n, size, _ in want) and len(rows) >= 14
        times = {n: at for n, _, at in want}
        assert all(abs(r.at / 1e6 - times[r.path]) < 1.1 for r in rows)


def test_listing_splits_by_tasks_only(tree):
    for tasks in (1, 3, 50):
        shares = listing.ListingReader(tree, tasks).partitions()
        assert len(shares) <= tasks and sum(len(s.flat) for s in shares) <= tasks


def test_read_verify_of_written_files(spark, tmp_path):
    """One file is cut short, one gone, one has a length far beyond its own in the manifest."""
    root = str(tmp_path / "t")
    sinks.write_texts(spark.range(400).select((F.col("id") % 4).alias("k"), F.col("id").cast("string").alias("line")), root, "line", ["k"])
    files = {r.parent: r for r in listing.list_tree(spark, root).where("not is_dir and name like 'part-%'").collect()}
    assert set(files) == {f"k={i}" for i in range(4)}
    rows = [(r.path, r.length) for r in files.values() if r.parent != "k=3"] + [(files["k=3"].path, 10**18)]
    full = os.path.join(root, files["k=1"].path)
    os.truncate(full, 11)
    os.rename(os.path.join(root, files["k=2"].path), str(tmp_path / "elsewhere"))
    manifest = spark.createDataFrame(rows, "path string, expected_length bigint")
    bad = {r.path: (r.expected_length, r.length) for r in listing.read_verify(spark, root, manifest).collect()}
    assert bad == {
        files["k=1"].path: (files["k=1"].length, 11), files["k=2"].path: (files["k=2"].length, None),
        files["k=3"].path: (10**18, files["k=3"].length),
    }


def test_listing_needs_a_directory(spark, tree):
    with pytest.raises(FileNotFoundError):
        listing.list_tree(spark, tree + "/top.txt")


def test_read_verify(spark, tree, monkeypatch):
    rows = [("top.txt", 3), ("a/x", 11), ("gone", 1), ("a/b/c/deep", 0), ("z/x", 4)]
    manifest = spark.createDataFrame(rows, "path string, expected_length bigint")
    bad = {r.path: r.length for r in listing.read_verify(spark, tree, manifest).collect()}
    assert bad == {"a/x": 10, "gone": None, "z/x": 5}
    # Ranges of four bytes: the longest file is read in pieces by several tasks.
    monkeypatch.setattr(listing, "_RANGE", 4)
    pieces = {r.path: r.length for r in listing.read_lengths(spark, tree, manifest).collect()}
    assert pieces == {"top.txt": 3, "a/x": 10, "gone": None, "a/b/c/deep": 0, "z/x": 5}


def test_read_lines(spark, tmp_path):
    for name, count in [("a.txt", 500), ("b.txt", 3)]:
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, count + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = tables.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 503
    for r in rows:
        assert r.line == f"{os.path.basename(r.file)} {r.line_no}"


@pytest.mark.parametrize("block", [3, 65_536])
def test_manifests(spark, monkeypatch, block):
    monkeypatch.setattr(manifests, "_BLOCK", block)
    flat = spark.createDataFrame([(0, 2, 5), (1, 1, 1), (2, 0, 4)], "thread bigint, subdirs bigint, files bigint")
    got = sorted(r.path for r in manifests.gen_manifest(flat).collect())
    want = [f"thread_0/subdir_{s}/file_{f}" for s in range(2) for f in range(5)] + ["thread_1/subdir_0/file_0"]
    assert got == sorted(want)
    tree = spark.createDataFrame([(0, [2, 3], 2), (1, [], 1)], "thread bigint, dirs_per_level array<int>, files bigint")
    got = sorted(r.path for r in manifests.gen_tree_manifest(tree).collect())
    want = [f"d0/d{a}/d{b}/f{f}" for a in range(2) for b in range(3) for f in range(2)] + ["d1/f0"]
    assert got == sorted(want)


def test_manifest_forms(spark):
    tree = spark.createDataFrame([(3, [2, 1], 1), (4, [], 1)], "thread bigint, dirs_per_level array<int>, files bigint")
    pairs = manifests.gen_tree_manifest(tree.where("thread = 3"), "subdir", "blk_", ("", ".meta"))
    assert sorted(r.path for r in pairs.collect()) == [
        f"d3/subdir{a}/subdir0/blk_0{end}" for a in range(2) for end in ("", ".meta")]
    dirs = sorted(r.path for r in manifests.gen_dir_manifest(tree).collect())
    assert dirs == ["d3/d0", "d3/d0/d0", "d3/d1", "d3/d1/d0"]


def test_sinks(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 2).alias("worker"), "id")
    path = str(tmp_path / "fanout")
    sinks.fanout(df, path, "worker", max_records=20)
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["worker=0", "worker=1"]
    assert 1 < len([f for f in os.listdir(path + "/worker=0") if f.endswith(".parquet")]) <= 6
    assert spark.read.parquet(path).count() == 100
    path = str(tmp_path / "fanout-cold")
    odd = df.where("id < 60").unionByName(spark.createDataFrame([(None, 1), (None, 1)], df.schema))
    sinks.fanout(odd, path, "worker", max_records=30)
    assert [len(glob.glob(f"{path}/worker={w}/*.parquet")) for w in (0, 1)] == [1, 1]
    assert spark.read.parquet(path).where("worker is null").count() == 2 and spark.read.parquet(path).count() == 62
    path = str(tmp_path / "over")
    sinks.overwrite(df, path, ["worker"])
    sinks.overwrite(df.where("worker = 1 and id < 10"), path, ["worker"])
    assert spark.read.parquet(path).groupBy("worker").count().orderBy("worker").collect() == [(0, 50), (1, 5)]
    path = str(tmp_path / "append")
    sinks.append(df, path)
    sinks.append(df, path)
    assert spark.read.parquet(path).count() == 200
    names = sinks.register_tables(spark, "sinks_test", {"t": path})
    assert names == ["sinks_test.t"] and spark.table("sinks_test.t").count() == 200


def test_registering_harms_no_managed_table(spark, tmp_path):

    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(5).write.parquet(str(tmp_path / "b"))
    for name, n in (("a", 3), ("a", 3), ("b", 5)):
        (full,) = sinks.register_tables(spark, "register_test", {"t": str(tmp_path / name)})
        assert spark.table(full).count() == n
    spark.sql("drop table if exists register_test.own")
    spark.range(7).write.saveAsTable("register_test.own")
    with pytest.raises(ValueError):
        sinks.register_tables(spark, "register_test", {"own": str(tmp_path / "a")})
    assert spark.table("register_test.own").count() == 7
    spark.sql("drop database register_test cascade")
