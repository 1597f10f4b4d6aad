"""A trigger of the paced reader starts no task that has nothing to read."""

import json
from pathlib import Path

from lakeaudit.streaming import paced


def test_tasks_of_a_trigger_follow_its_bytes(spark, tmp_path, monkeypatch):
    root, table = tmp_path / "files", tmp_path / "table"
    root.mkdir()
    sizes = {f"f{i}": 10 + i for i in range(12)}
    for name, size in sizes.items():
        (root / name).write_bytes(b"x" * size)
    files = spark.createDataFrame([*sizes.items()], "path string, length bigint")
    monkeypatch.setattr(paced, "new_path", lambda spark, name: str(table))
    paced.drain(paced.paced_read(spark, str(root), files, 8), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [p.name for p in Path(table).glob("part=*")] == ["part=0"]
    totals = {r.path: (r.length, r.triggers, r.most) for r in paced.paced_totals(spark, str(tmp_path / "out")).collect()}
    assert totals == {name: (size, -(-size // 8), 8) for name, size in sizes.items()}


def test_no_task_for_files_that_have_ended():
    options = {"root": "/", "table": "/", "step": "10", "longest": json.dumps({0: 25, 1: 7, 3: 12})}
    reader = paced._PacedReader(options)
    at = lambda start, end: [p.part for p in reader.partitions({"at": start}, {"at": end})]
    assert (at(0, 10), at(10, 20), at(20, 25), at(25, 25)) == ([0, 1, 3], [0, 3], [0], [])
