"""The registered queries: one callable (spark, sf) -> DataFrame per operator."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.functions import paths, sizes
from lakeaudit.operators import (
    duplicates,
    inventory,
    kv,
    lines,
    oplog,
    records,
    runs,
    trees,
)
from lakeaudit.operators.inventory import drop_hidden
from lakeaudit.plans import params as P
from lakeaudit.plans import views as V
from lakeaudit.session import new_path
from lakeaudit.sources import listing, manifests, sinks, tables
from lakeaudit.streaming import paced, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _cutoff() -> Column:
    return F.lit(P.CUTOFF).cast("timestamp_ntz")


def _seek() -> Column:
    return F.lit(P.SEEK).cast("timestamp_ntz")


# --- sources and sinks -------------------------------------------------------


def _listed(found: DataFrame) -> DataFrame:
    """Entries of a written folder, without Spark's own files, and with the task's name taken out of a data file's."""
    path = F.regexp_replace("path", "/part-[^/]*$", "/data")
    return drop_hidden(found).where("name <> '_SUCCESS'").select(path.alias("path"), "is_dir", "listed", "length", F.col("mtime").isNotNull().alias("has_mtime"))


@query
def src_listing(spark, sf):
    """Lists, level by level, a folder of text files written from the documents: directories and files with their lengths."""
    root = new_path(spark, "shelves")
    sinks.write_texts(V.shelves(spark, sf), root, "line", ["lang", "shelf"])
    return _listed(listing.list_tree(spark, root))


@query
def src_fs_listing(spark, sf):
    """The same folder through the lazy data source, a group of sub-trees for each task."""
    root = new_path(spark, "shelves")
    sinks.write_texts(V.shelves(spark, sf), root, "line", ["lang", "shelf"])
    return _listed(listing.fs_listing(spark, root, tasks=8))


@query
def src_children(spark, sf):
    found = inventory.children(V.entries(spark, sf), P.CHILD_ROOT)
    return found.select("path", "is_dir", "length", "mtime")


@query
def src_read_verify(spark, sf):
    """Reads every file of a folder and checks the number of bytes; some files were cut short, some never written."""
    root, shelves = new_path(spark, "shelves"), V.shelves(spark, sf)
    sinks.write_texts(shelves.where("shelf <> 7 and doc_id % 97 <> 0"), root, "line", ["lang", "shelf"])
    folder = F.format_string("lang=%s/shelf=%d", "lang", "shelf")
    expected = shelves.groupBy(folder.alias("parent")).agg(F.sum(F.octet_length("line") + 1).cast("bigint").alias("expected_length"))
    files = drop_hidden(listing.list_tree(spark, root)).where("not is_dir and name <> '_SUCCESS'").select("parent", "path")
    manifest = expected.join(files, "parent", "left").select(
        F.coalesce("path", F.concat("parent", F.lit("/gone"))).alias("path"), "expected_length"
    )
    wrong = listing.read_verify(spark, root, manifest)
    return wrong.select(paths.parent_of(F.col("path")).alias("folder"), "expected_length", "length")


@query
def kv_scan(spark, sf):
    return kv.kv_scan(V.kv(spark, sf)).select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


@query
def kv_prefix(spark, sf):
    """Writes the table in key order; the prefix then reaches the scan as a range of keys."""
    out = new_path(spark, "kv")
    sinks.write_kv(V.kv(spark, sf), out)
    return kv.kv_prefix(tables.read_kv(spark, out), P.KEY_PREFIX.encode()).select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


@query
def kv_seek_desc(spark, sf):
    return kv.seek_desc(V.entities(spark, sf), _seek())


@query
def kv_seek_newest(spark, sf):
    """Writes the entities newest first; the moment sought then reaches the scan as a range of keys."""
    out = new_path(spark, "newest")
    sinks.write_newest_first(V.entities(spark, sf), out)
    found = kv.seek_newest(spark.read.parquet(out), _seek())
    return found.select(F.hex("key").alias("key"), "entity_type", "entity_id", "start_ts")


@query
def kv_dump(spark, sf):
    """Writes the dump and reads its lines back."""
    out = new_path(spark, "dump")
    sinks.write_dump(V.kv(spark, sf), out)
    return spark.read.text(out).select(F.col("value").alias("line"))


@query
def src_inventory_lines(spark, sf):
    return lines.drop_comments(V.host_lines(spark, sf))


@query
def sink_append(spark, sf):
    """The runs before, then those after, appended to one dataset."""
    out, all_runs = new_path(spark, "append"), V.runs(spark, sf)
    for phase in ("before", "after"):
        sinks.append(all_runs.where(F.col("phase") == phase), out)
    return spark.read.parquet(out)


@query
def sink_overwrite(spark, sf):
    """Each repeat rewrites the levels it has rows for; the last write of a level wins."""
    out, all_runs = new_path(spark, "overwrite"), V.runs(spark, sf)
    for repeat in (1, 2, 3):
        sinks.overwrite(all_runs.where(F.col("repeat_no") == repeat), out, ["level"])
    return spark.read.parquet(out).select("suite", "phase", "repeat_no", "level", "metric", "value")


@query
def sink_fanout(spark, sf):
    out = new_path(spark, "fanout")
    sinks.fanout(V.runs(spark, sf), out, "level")
    return spark.read.parquet(out).select("suite", "phase", "repeat_no", "level", "metric", "value")


@query
def gen_manifest(spark, sf):
    return manifests.gen_manifest(V.layouts(spark, sf))


@query
def gen_tree_manifest(spark, sf):
    return manifests.gen_tree_manifest(V.layout_trees(spark, sf))


@query
def table_register(spark, sf):
    """Registers the given tables and counts their rows through the catalog."""
    database = "lakeaudit_" + hashlib.md5(sf.encode()).hexdigest()[:8]
    names = sinks.register_tables(spark, database, {t: f"{sf}/{t}.parquet" for t in P.TABLES})
    counts = [
        spark.table(full).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        for t, full in zip(P.TABLES, names)
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


# --- projections and filters ----------------------------------------------------


@query
def kv_count_contains(spark, sf):
    return kv.kv_count_contains(V.kv(spark, sf), P.KEY_TEXT)


@query
def retention_files(spark, sf):
    found = inventory.expired_files(V.entries(spark, sf), _cutoff())
    return found.select("path", "length", "mtime")


@query
def retention_exact_day(spark, sf):
    return kv.on_exact_day(V.entities(spark, sf), "start_ts", F.to_date(F.lit(P.REF_DAY)), P.DAYS_BACK)


@query
def proj_rel_path(spark, sf):
    """Every path as seen from its own top directory."""
    path = F.col("path")
    return V.entries(spark, sf).select("path", paths.rel_path(path, F.substring_index(path, "/", 1)).alias("rel"))


@query
def filter_hidden(spark, sf):
    return inventory.drop_hidden(V.entries(spark, sf)).select("path", "name")


@query
def grep_context(spark, sf):
    return lines.grep_context(V.lines(spark, sf), P.GREP)


@query
def report_extract(spark, sf):
    return lines.report_extract(V.report_lines(spark, sf), P.REPORT_HEAD)


@query
def health_gate(spark, sf):
    found = lines.report_extract(V.report_lines(spark, sf), P.REPORT_HEAD)
    return lines.health_gate(found, P.REQUIRED_NODES)


# --- joins -------------------------------------------------------------------------


@query
def tree_diff_missing(spark, sf):
    return trees.tree_diff_missing(*V.entries_and_base(spark, sf))


@query
def tree_diff_kind(spark, sf):
    return trees.tree_diff_kind(*V.entries_and_base(spark, sf))


@query
def empty_dirs(spark, sf):
    return inventory.empty_dirs(V.entries(spark, sf))


@query
def manifest_check(spark, sf):
    return trees.manifest_check(V.entries(spark, sf), V.expected(spark, sf))


# --- aggregations --------------------------------------------------------------------


@query
def kv_group_count(spark, sf):
    return kv.kv_group_count(V.kv(spark, sf))


@query
def dir_child_count(spark, sf):
    return inventory.dir_child_count(V.entries(spark, sf))


@query
def retention_dirs(spark, sf):
    return inventory.removable_dirs(V.entries(spark, sf), _cutoff())


@query
def retention_plan(spark, sf):
    return inventory.retention_plan(V.entries(spark, sf), _cutoff())


@query
def op_min_max_total(spark, sf):
    return oplog.min_max_total(V.oplog(spark, sf))


@query
def op_slowest(spark, sf):
    return oplog.slowest(V.oplog(spark, sf))


@query
def op_throughput(spark, sf):
    return oplog.throughput(V.oplog(spark, sf))


@query
def op_mode_split(spark, sf):
    return oplog.mode_split(V.oplog(spark, sf), P.READ_SHARE)


@query
def op_batch_time(spark, sf):
    return oplog.batch_time(V.oplog(spark, sf), P.BATCH)


@query
def op_gc_adjusted(spark, sf):
    return oplog.gc_adjusted(V.oplog(spark, sf))


@query
def op_cpu_usage(spark, sf):
    return oplog.cpu_usage(V.oplog(spark, sf))


@query
def entity_types(spark, sf):
    return kv.entity_types(V.entities(spark, sf))


@query
def entity_ttl(spark, sf):
    return kv.entity_ttl(V.entities(spark, sf), _seek())


@query
def dir_expect_count(spark, sf):
    return inventory.dir_expect_count(V.stored(V.entries(spark, sf), "entries"), P.EXPECTED_CHILDREN)


@query
def mask_bucket(spark, sf):
    return oplog.mask_bucket(V.table(spark, sf, "events"), "event_id")


@query
def ab_compare(spark, sf):
    return runs.ab_compare(V.runs(spark, sf))


@query
def human_size_rollup(spark, sf):
    return runs.human_size_rollup(V.size_texts(spark, sf), "grp", "size_txt", "time_txt")


# --- windows ---------------------------------------------------------------------------


@query
def dup_files(spark, sf):
    return duplicates.dup_files(V.dup(spark, sf))


@query
def op_running_max(spark, sf):
    return oplog.running_max(V.oplog(spark, sf), P.REPORT_EVERY)


@query
def op_milestones(spark, sf):
    return oplog.milestones(V.oplog(spark, sf)).select("worker", "seq", "op", "start_ts", "elapsed")


@query
def op_running_total(spark, sf):
    return oplog.running_total(V.oplog(spark, sf))


@query
def id_gap(spark, sf):
    return oplog.id_gap(V.table(spark, sf, "events"), "event_id")


# --- sorts and top-k ----------------------------------------------------------------------


@query
def top_dirs(spark, sf):
    return inventory.top_dirs(V.entries(spark, sf), P.TOP)


@query
def tail_n(spark, sf):
    return records.tail_n(V.records(spark, sf), P.TAIL)


@query
def record_verify(spark, sf):
    """Every record that fails, and whether the tail check or the sample check would see it."""
    return records.verified(V.records(spark, sf), P.TAIL, P.ONE_IN)


# --- scalar functions ------------------------------------------------------------------------


@query
def parse_size(spark, sf):
    return V.size_texts(spark, sf).select(
        "p_partkey", "size_txt", sizes.parse_size(F.col("size_txt")).alias("bytes")
    )


@query
def parse_time(spark, sf):
    return V.size_texts(spark, sf).select(
        "p_partkey", "time_txt", sizes.parse_time(F.col("time_txt")).alias("millis")
    )


@query
def format_size(spark, sf):
    n = V.cents("o_totalprice") * (F.col("o_orderkey") % 1000)
    return V.table(spark, sf, "orders").select(
        "o_orderkey", n.alias("bytes"), sizes.format_size(n).alias("size_txt")
    )


@query
def format_time(spark, sf):
    n = V.cents("o_totalprice") * (F.col("o_orderkey") % 10)
    return V.table(spark, sf, "orders").select(
        "o_orderkey", n.alias("millis"), sizes.format_time(n).alias("time_txt")
    )


@query
def split_ints(spark, sf):
    numbers = F.col("dirs_per_level")
    total = F.aggregate(numbers, F.lit(0), lambda a, x: a + x)
    return V.layout_trees(spark, sf).select(
        "thread", F.size(numbers).alias("levels"), total.alias("total"), F.get(numbers, F.lit(2)).alias("third")
    )


@query
def path_parts(spark, sf):
    path = F.col("path")
    return V.entries(spark, sf).select(
        "path",
        paths.parent_of(path).alias("parent"),
        paths.name_of(path).alias("name"),
        paths.depth_of(path).alias("depth"),
        F.array_join(paths.segments_of(path), "|").alias("segments"),
        F.array_join(paths.ancestors_of(path), "|").alias("ancestors"),
    )


# --- streams ----------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str, **limits) -> DataFrame:
    schema = V.table(spark, sf, name).schema
    # A glob, since a stream takes a plain path for a directory and a table may be one file.
    return streams.read_files(spark, f"{sf}/{name}.parque[t]", schema, **limits)


@query
def stream_op_rollup(spark, sf):
    """Every window's latest state, those the watermark has not closed included."""
    out, checkpoint = new_path(spark, "rollup"), new_path(spark, "rollup-state")
    log = V.op_events(_stream(spark, sf, "events"))
    streams.drain_updates(streams.op_rollup(log, P.WINDOW, P.DELAY), out, checkpoint)
    return streams.latest_rollup(spark, out)


@query
def stream_running_max(spark, sf):
    out, checkpoint = new_path(spark, "max"), new_path(spark, "max-state")
    streams.drain_updates(streams.worker_max(V.op_events(_stream(spark, sf, "events"))), out, checkpoint)
    return streams.latest_worker_max(spark, out)


@query
def stream_expect_alert(spark, sf):
    """Directories with a wrong number of children over all that the stream brought, however it was cut."""
    out, checkpoint = new_path(spark, "alerts"), new_path(spark, "alerts-state")
    files = _stream(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"),
    )
    # a stop at the first bad batch would leave the rest of the stream unread
    streams.drain_expect_alert(files, P.EXPECTED_CHILDREN, out, checkpoint, stop=False)
    return streams.alerts(spark, out)


@query
def stream_throttled_read(spark, sf):
    """One file per trigger until all are read; the rows arrive unchanged."""
    out, checkpoint = new_path(spark, "throttled"), new_path(spark, "throttled-state")
    streams.drain_append(_stream(spark, sf, "events", max_files=1), out, checkpoint)
    return spark.read.parquet(out)


@query
def stream_rollup_late(spark, sf):
    """The rollup of a log that arrives in bunches, some rows weeks after their time, with the number of late rows."""
    src, out, checkpoint = (new_path(spark, name) for name in ("arrivals", "late", "late-state"))
    held = F.when(F.col("event_id") % P.HELD_BACK == 0, F.lit(7)).otherwise(F.lit(0))
    week = F.floor((F.dayofyear("start_ts") - 1 + held) / 7)
    log = V.op_events(V.table(spark, sf, "events"))
    for bunch in range(P.BUNCHES):
        here = F.least(week, F.lit(P.BUNCHES - 1)) == bunch
        sinks.append(log.where(F.coalesce(here, F.lit(bunch == P.BUNCHES - 1))), src)
        streams.drain_rollup_with_late(spark.readStream.schema(log.schema).parquet(src), out, checkpoint, P.WINDOW, P.DELAY)
    windows = streams.rollup_with_late(spark, out)
    late = streams.op_rollup(streams.late_rows(spark, out), P.WINDOW, P.DELAY).select("window_start", "window_end", "op", F.col("n").alias("late"))
    return windows.join(late, ["window_start", "window_end", "op"], "full").select(
        "window_start", "window_end", "op", F.coalesce("n", F.lit(0)).alias("n"), "max_elapsed", F.coalesce("late", F.lit(0)).alias("late")
    )


@query
def stream_paced_read(spark, sf):
    """Reads the documents, written as text files, so many bytes of each a trigger."""
    root, out, checkpoint = (new_path(spark, name) for name in ("shelves", "paced-out", "paced-state"))
    sinks.write_texts(V.shelves(spark, sf), root, "line", ["lang", "shelf"])
    files = drop_hidden(listing.list_tree(spark, root)).where("not is_dir and name <> '_SUCCESS'").select("path", "length")
    paced.drain(paced.paced_read(spark, root, files, P.PACE), out, checkpoint)
    return paced.paced_totals(spark, out).select(paths.parent_of(F.col("path")).alias("folder"), "length", "triggers", "most")


# --- caller-supplied functions ------------------------------------------------------------------


def _key_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = pdf["key"].map(bytes.decode)
        parts = text.str.split("!", expand=True) if len(pdf) else pd.DataFrame({0: [], 1: [], 2: []})
        yield pd.DataFrame(
            {
                "kind": parts[0],
                "user_id": parts[1].astype("int64"),
                "event_id": parts[2].astype("int64"),
                "value_len": pdf["value"].map(len).astype("int64"),
            }
        )


@query
def kv_map_partitions(spark, sf):
    schema = "kind string, user_id bigint, event_id bigint, value_len bigint"
    return kv.map_kv(V.kv(spark, sf), _key_parts, schema)
