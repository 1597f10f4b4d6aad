"""Tree operators against plain recursive walks on random small trees."""

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import duplicates, inventory, ordered, trees
from tests.trees import (
    CUTOFF,
    kids,
    random_tree,
    to_df,
    walk_duplicates,
    walk_kind,
    walk_missing,
    walk_removable,
)

SEEDS = [4, 12, 13]


def changed(tree, seed):
    """The same tree with some sub-trees gone and some directories turned into files."""
    import random

    rng, out = random.Random(seed + 100), {}
    gone = {p for p in tree if p and rng.random() < 0.2}
    turned = {p for p in tree if p and tree[p]["is_dir"] and rng.random() < 0.2}
    for path, row in tree.items():
        above = {path[: i] for i, c in enumerate(path) if c == "/"}
        if path in gone or above & gone or above & turned:
            continue
        out[path] = dict(row, is_dir=False) if path in turned else row
    return out


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_diff(spark, seed, hot_rows):
    target = random_tree(seed)
    base = changed(target, seed)
    t, b = to_df(spark, target), to_df(spark, base)
    missing = [r.path for r in trees.tree_diff_missing(t, b, hot_rows).collect()]
    assert sorted(missing) == sorted(walk_missing(target, base)) and missing
    kind = [r.path for r in trees.tree_diff_kind(t, b).collect()]
    assert sorted(kind) == sorted(walk_kind(target, base))


@pytest.mark.parametrize("seed", SEEDS)
def test_retention(spark, seed):
    tree = random_tree(seed, p_old=0.9)
    df = to_df(spark, tree)
    cutoff = F.lit(CUTOFF.isoformat(" ")).cast("timestamp_ntz")
    dirs = {r.path: r.removable for r in inventory.removable_dirs(df, cutoff).collect()}
    assert dirs == walk_removable(tree)
    plan = {r.path: r.action for r in inventory.retention_plan(df, cutoff).collect()}
    assert set(plan) == set(tree)
    for path, row in tree.items():
        gone = dirs[path] if row["is_dir"] else row["mtime"] < CUTOFF
        assert plan[path] == ("delete" if gone else "keep")


def test_one_new_grandchild_keeps_all_above(spark):
    import datetime as dt

    old, new = dt.datetime(2000, 1, 1), dt.datetime(2020, 1, 1)
    tree = {p: {"is_dir": d, "length": 0, "mtime": m} for p, d, m in [
        ("", True, old), ("a", True, old), ("a/b", True, old), ("a/b/f", False, new), ("e", True, old)]}
    cutoff = F.lit(CUTOFF.isoformat(" ")).cast("timestamp_ntz")
    out = {r.path: (r.own_old, r.removable) for r in inventory.removable_dirs(to_df(spark, tree), cutoff).collect()}
    assert out == {"": (True, False), "a": (True, False), "a/b": (True, False), "e": (True, True)}
    unread = to_df(spark, tree).withColumn("listed", F.col("path") != "e")
    out = {r.path: r.removable for r in inventory.removable_dirs(unread, cutoff).collect()}
    assert out["e"] is False


def test_cutoff_does_not_overflow(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(inventory.cutoff_before(now, hours=700_000), inventory.cutoff_before(now, days=2)).first()
    assert row[0].year == 1944 and row[1].day == 30


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("parts", [1, 100])
def test_duplicates(spark, seed, parts, monkeypatch):
    monkeypatch.setattr(ordered, "_ONE_IN", 1)
    tree = random_tree(seed, depth=5)
    found = duplicates.dup_files(to_df(spark, tree), parts).collect()
    assert sorted((r.path, r.rep) for r in found) == sorted(walk_duplicates(tree)) and found
    assert found[0].rm_cmd == f"rm -rf '{found[0].path}'"
    assert found[0].ln_cmd == f"ln -s '{found[0].rep}' '{found[0].path}'"


@pytest.mark.parametrize("parts", [1, 4, 100])
def test_duplicate_chain(spark, parts, monkeypatch):
    """Sizes A A B A: only the second is a duplicate; a long run keeps its first path."""
    monkeypatch.setattr(ordered, "_ONE_IN", 1)
    sizes = [7, 7, 8, 7] + [7] * 20 + [None, None]
    rows = [(f"d{i:02d}/x", "x", s, False) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "path string, name string, length bigint, is_dir boolean")
    out = sorted((r.path, r.rep) for r in duplicates.dup_files(df, parts).collect())
    run = [(f"d{i:02d}/x", "d03/x") for i in range(4, 24)]
    assert out == [("d01/x", "d00/x"), *run, ("d25/x", "d24/x")]


def test_duplicates_of_a_name_with_half_of_all_files(spark, monkeypatch):
    """Runs far longer than a block keep their first path."""
    monkeypatch.setattr(ordered, "_ONE_IN", 1)
    sizes = [1] * 700 + [2, 1] * 50 + [3] * 700
    rows = [(f"d{i:05d}/hot", "hot", s, False) for i, s in enumerate(sizes)]
    rows += [(f"e{i:05d}/n{i % 300}", f"n{i % 300}", i % 600 // 300, False) for i in range(1_500)]
    df = spark.createDataFrame(rows, "path string, name string, length bigint, is_dir boolean")
    last, want = {}, set()
    for path, name, size, _ in sorted(rows):
        if name in last and last[name][0] == size:
            want.add((path, last[name][1]))
        else:
            last[name] = (size, path)
    for parts in (16, 200):
        got = [(r.path, r.rep) for r in duplicates.dup_files(df.repartition(5), parts).collect()]
        assert set(got) == want and len(got) == len(want) > 1_300


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_counts(spark, seed, hot_rows):
    tree = random_tree(seed)
    df = to_df(spark, tree)
    dirs = {p: len(kids(tree, p)) for p, r in tree.items() if r["is_dir"]}
    assert {r.path: r.n for r in inventory.dir_child_count(df).collect()} == dirs
    assert {r.path for r in inventory.empty_dirs(df).collect()} == {p for p, n in dirs.items() if not n}
    for n in (1, 3, len(dirs), len(dirs) + 5):
        top = [(r.path, r.n) for r in inventory.top_dirs(df, n).collect()]
        assert top == sorted(dirs.items(), key=lambda x: (-x[1], x[0]))[:n]
    for expected in (0, 2):
        wrong = {(r.path, r.n, r.child) for r in inventory.dir_expect_count(df, expected, hot_rows).collect()}
        want = set()
        for path, n in dirs.items():
            if n != expected:
                want |= {(path, n, c.rpartition("/")[2]) for c in kids(tree, path)} or {(path, 0, None)}
        assert wrong == want


def test_hidden_only_directory_is_not_empty(spark):
    from tests.trees import OLD

    tree = {p: {"is_dir": d, "length": 0, "mtime": OLD} for p, d in [("", True), ("a", True), ("a/.x", False)]}
    df = to_df(spark, tree)
    assert inventory.empty_dirs(df).count() == 0
    assert [r.path for r in inventory.children(df, "").collect()] == ["a"]


def test_manifest(spark):
    rows = [("a", False, 1), ("b", False, 2), ("d", True, 0), ("x", False, 9)]
    entries = spark.createDataFrame(rows, "path string, is_dir boolean, length bigint")
    manifest = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "path string, expected_length bigint")
    out = {r.path: r.status for r in trees.manifest_check(entries, manifest).collect()}
    assert out == {"a": "ok", "b": "wrong length", "c": "missing", "x": "unexpected"}
    wrong = {r.path: r.length for r in trees.wrong_lengths(entries, manifest).collect()}
    assert wrong == {"b": 2, "c": None}
