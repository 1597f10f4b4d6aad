"""What the physical plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from lakeaudit.plans.catalog import QUERIES
from lakeaudit.operators import inventory
from lakeaudit.plans import views as V

WRITES = {k for k in QUERIES if k.startswith(("sink_", "stream_", "src_listing", "src_fs_", "src_read_", "kv_dump", "table_"))}
PYTHON = ("EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("key", sorted(set(QUERIES) - WRITES))
def test_no_cross_join_and_no_python(spark, sf, key):
    text = plan(QUERIES[key](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert key == "kv_map_partitions" or not any(node in text for node in PYTHON)


def test_scans_read_only_what_is_needed(spark, sf):
    text = plan(entry.queries()["kv_group_count"](spark, sf))
    assert "props" not in text
    text = plan(entry.queries()["kv_prefix"](spark, sf))
    assert "GreaterThanOrEqual(key" in text and "LessThan(key" in text
    text = plan(entry.queries()["kv_seek_newest"](spark, sf))
    assert "GreaterThanOrEqual(key" in text and "Exchange" not in text
    text = plan(entry.queries()["entity_types"](spark, sf))
    assert "ReadSchema: struct<event_type:string>" in text
    text = plan(entry.queries()["retention_exact_day"](spark, sf))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


def test_top_dirs_sorts_in_heaps(spark, sf):
    text = plan(inventory.top_dirs(V.entries(spark, sf), 5))
    assert text.count("TakeOrderedAndProject") >= 3 and "Window" not in text
