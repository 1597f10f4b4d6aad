"""Random small trees and plain recursive walks, the second opinion for tree operators."""

from __future__ import annotations

import datetime as dt
import random

SCHEMA = "path string, is_dir boolean, length bigint, mtime timestamp_ntz, parent string, name string"
NAMES = ["a", "b", "a-b", "a.b", ".h", "c"]
OLD, NEW = dt.datetime(2000, 1, 1), dt.datetime(2020, 1, 1)
CUTOFF = dt.datetime(2010, 1, 1)


def random_tree(seed: int, depth: int = 4, p_old: float = 0.8) -> dict[str, dict]:
    """path -> row; a tree with the root, empty directories and hidden names."""
    rng = random.Random(seed)
    rows: dict[str, dict] = {}

    def add(path: str, is_dir: bool) -> None:
        rows[path] = {
            "is_dir": is_dir,
            "length": 0 if is_dir else rng.choice([1, 2]),
            "mtime": OLD if rng.random() < p_old else NEW,
        }

    def grow(path: str, level: int) -> None:
        add(path, True)
        for name in NAMES:
            kind = rng.random()
            child = f"{path}/{name}" if path else name
            if kind < 0.3 and level < depth:
                grow(child, level + 1)
            elif kind < 0.7:
                add(child, False)

    grow("", 0)
    return rows


def to_df(spark, tree: dict[str, dict]):
    rows = []
    for path, r in tree.items():
        head, _, name = path.rpartition("/")
        rows.append((path, r["is_dir"], r["length"], r["mtime"], head if path else None, name))
    return spark.createDataFrame(rows, SCHEMA)


def kids(tree: dict[str, dict], path: str) -> list[str]:
    prefix = f"{path}/" if path else ""
    return sorted(
        p for p in tree if p and p.startswith(prefix) and "/" not in p[len(prefix) :] and p != path
    )


def walk_missing(target, base, path=""):
    out = []
    for child in kids(target, path):
        if child not in base:
            if not child.rpartition("/")[2].startswith("."):
                out.append(child)
        elif target[child]["is_dir"] and base[child]["is_dir"]:
            out += walk_missing(target, base, child)
    return out


def walk_kind(target, base, path=""):
    out = []
    for child in kids(target, path):
        if child in base:
            if target[child]["is_dir"] and base[child]["is_dir"]:
                out += walk_kind(target, base, child)
            elif target[child]["is_dir"] != base[child]["is_dir"]:
                out.append(child)
    return out


def walk_removable(tree, path=""):
    """{directory: removable} for the whole tree below ``path``."""
    out, every = {}, True
    for child in kids(tree, path):
        if tree[child]["is_dir"]:
            out |= walk_removable(tree, child)
            every = out[child] and every
        else:
            every = tree[child]["mtime"] < CUTOFF and every
    out[path] = every and tree[path]["mtime"] < CUTOFF
    return out


def walk_duplicates(tree, path="", last=None):
    """(duplicate, representative) in the order of the walk."""
    last = {} if last is None else last
    out = []
    for child in kids(tree, path):
        if tree[child]["is_dir"]:
            out += walk_duplicates(tree, child, last)
            continue
        name, size = child.rpartition("/")[2], tree[child]["length"]
        if name in last and last[name][1] == size:
            out.append((child, last[name][0]))
        else:
            last[name] = (child, size)
    return out
