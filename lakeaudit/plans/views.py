"""The library's record shapes as views over the given Parquet tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeaudit.functions import paths, sizes
from lakeaudit.functions.numbers import div
from lakeaudit.operators.ordered import ranked
from lakeaudit.operators.skew import salted_join
from lakeaudit.session import new_path


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    """Schema from the file footer, read once per session and table."""
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """(n_nationkey, place): the two upper levels, region/nation."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("place"), "r_name"
    )


def _customer_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """(o_custkey, dir): the directory of every customer."""
    joined = table(spark, sf, "customer").join(
        _places(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        F.col("c_custkey").alias("o_custkey"),
        F.concat(F.col("place"), F.lit("/c"), _text("c_custkey")).alias("dir"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per order, in its customer's directory; a busy customer is salted."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    prefix = F.when(F.col("o_orderkey") % 11 == 0, ".f").otherwise("f")
    return salted_join(orders, _customer_dirs(spark, sf), "o_custkey", ["o_orderkey"]).select(
        F.concat(F.col("dir"), F.lit("/"), prefix, _text("o_orderkey")).alias("path"),
        F.lit(False).alias("is_dir"),
        cents("o_totalprice").alias("length"),
        F.col("o_orderdate").alias("mtime"),
        "o_orderkey",
        "o_custkey",
    )


def dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Root, regions, nations, customers with orders, and suppliers (empty)."""
    old = _ntz("1995-01-01 00:00:00")
    places = _places(spark, sf)
    root = table(spark, sf, "region").agg(F.lit("").alias("path"), F.max(old).alias("mtime"))
    regions = table(spark, sf, "region").select(F.col("r_name").alias("path"), old.alias("mtime"))
    nations = places.select(F.col("place").alias("path"), old.alias("mtime"))
    # Orders are reduced to one row per customer before the join.
    newest = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("mtime"))
    customers = newest.join(_customer_dirs(spark, sf), "o_custkey").select(
        F.col("dir").alias("path"), "mtime"
    )
    odd = F.col("s_suppkey") % 2 == 1
    suppliers = (
        table(spark, sf, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.col("place"), F.lit("/s"), _text("s_suppkey")).alias("path"),
            F.when(odd, _ntz("2001-12-31 00:00:00")).otherwise(old).alias("mtime"),
        )
    )
    return root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(suppliers)


def _keyed_entries(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("bigint")
    folders = dirs(spark, sf).select(
        "path",
        F.lit(True).alias("is_dir"),
        F.lit(0).cast("bigint").alias("length"),
        "mtime",
        none.alias("o_orderkey"),
        none.alias("o_custkey"),
    )
    path = F.col("path")
    return (
        files(spark, sf)
        .unionByName(folders)
        .withColumn("parent", paths.parent_of(path))
        .withColumn("name", paths.name_of(path))
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed_entries(spark, sf).drop("o_orderkey", "o_custkey")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder, for a view that a query reads several times.

    A listing is a stored table in practice; here it is derived by joins that
    would otherwise run again for every use.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entries_and_base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a comparison, from one stored listing.

    On the other side parts are missing and some directories are files.
    """
    keyed = stored(_keyed_entries(spark, sf), "entries")
    kept_file = (F.col("o_orderkey") % 7 != 0) & (F.col("o_custkey") % 10 != 3)
    kept = F.coalesce(kept_file, ~F.col("name").like("c%3"))
    clash = F.col("name").like("s%0")
    base = keyed.where(kept).select(
        "path", F.when(clash, False).otherwise(F.col("is_dir")).alias("is_dir"), "length"
    )
    return keyed.drop("o_orderkey", "o_custkey"), base


def dup(spark: SparkSession, sf: str) -> DataFrame:
    """Few names in many directories, with changing sizes."""
    name = F.concat(F.lit("n"), _text("o_custkey"))
    folder = F.concat(F.lit("d"), F.lpad(_text("o_orderkey"), 12, "0"))
    return table(spark, sf, "orders").select(
        F.concat_ws("/", folder, name).alias("path"),
        name.alias("name"),
        F.ascii("o_orderstatus").cast("bigint").alias("length"),
        F.lit(False).alias("is_dir"),
    )


def expected(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest that disagrees with the listing here and there."""
    off = F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0)

    def row(path: Column, length: Column) -> Column:
        return F.struct(path.alias("path"), length.alias("expected_length"))

    path, length = F.col("path"), F.col("length")
    wanted, gone = row(path, length + off), row(F.concat(path, F.lit(".gone")), length)
    both = F.array(
        F.when(F.col("o_orderkey") % 13 != 0, wanted), F.when(F.col("o_orderkey") % 101 == 0, gone)
    )
    return files(spark, sf).select(F.inline(F.filter(both, lambda r: r.isNotNull())))


def kv(spark: SparkSession, sf: str) -> DataFrame:
    """Binary key ``type!user!event`` with a binary value."""
    key = F.concat_ws("!", "event_type", _text("user_id"), F.lpad(_text("event_id"), 12, "0"))
    return table(spark, sf, "events").select(
        key.cast("binary").alias("key"), F.col("props").cast("binary").alias("value")
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("entity_type"),
        F.col("event_id").alias("entity_id"),
        F.col("ts").alias("start_ts"),
    )


def op_events(events: DataFrame) -> DataFrame:
    """Timed operations without their number; for batches and streams alike."""
    elapsed = cents("value")
    gc = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return events.select(
        F.col("user_id").alias("worker"),
        F.col("event_type").alias("op"),
        F.col("ts").alias("start_ts"),
        elapsed.alias("elapsed"),
        F.least(gc, elapsed).alias("gc"),
        (F.col("event_id") % 5 + 1).alias("items"),
        "event_id",
    )


def oplog(spark: SparkSession, sf: str) -> DataFrame:
    """Timed operations, numbered per worker; a busy worker is numbered in blocks."""
    return ranked(op_events(table(spark, sf, "events")), ["worker"], "event_id", "seq")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    file = F.concat_ws("-", "source", _text("doc_id"))
    return (
        table(spark, sf, "documents")
        .select(file.alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    )


def shelves(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as lines of text files, a file for each language and shelf."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.coalesce("lang", F.lit("none")).alias("lang"),
        (F.col("doc_id") % 16).alias("shelf"),
        F.coalesce("text", F.lit("")).alias("line"),
    )


def host_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Host lists, one per nation, with some hosts commented out."""
    mark = F.when(F.col("c_custkey") % 9 == 0, "#").otherwise("")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("hosts-"), _text("c_nationkey")).alias("file"),
        F.col("c_custkey").alias("line_no"),
        F.concat(mark, F.lower("c_name")).alias("line"),
    )


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A status report per customer; some lack the line on live nodes."""
    live = F.concat(F.lit("Live datanodes ("), _text(F.col("c_custkey") % 5), F.lit("):"))
    body = F.array(
        F.concat(F.lit("Configured Capacity: "), _text("c_custkey")),
        F.when(F.col("c_custkey") % 11 == 0, "Dead datanodes (1):").otherwise(live),
        F.concat(F.lit("Name: 10.0.0."), _text("c_nationkey")),
    )
    return (
        table(spark, sf, "customer")
        .select(
            F.concat(F.lit("report-"), _text("c_custkey")).alias("file"),
            F.posexplode(body).alias("pos", "line"),
        )
        .select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    phase = F.when(F.col("o_orderstatus") == "O", "before").otherwise("after")
    return (
        table(spark, sf, "orders")
        .select(
            F.col("o_orderpriority").alias("suite"),
            phase.alias("phase"),
            (F.col("o_orderkey") % 3 + 1).cast("int").alias("repeat_no"),
            (1000 * (F.col("o_custkey") % 5 + 1)).cast("int").alias("level"),
            F.lit("avg_time").alias("metric"),
            cents("o_totalprice").alias("value"),
        )
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Offset records, stored as a data file's records are; every 97th is corrupt."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("file"), "event_id")
    pos = (F.col("_n") - 1) * 8
    wrong = F.when(F.col("event_id") % 97 == 0, 8).otherwise(0)
    numbered = ranked(events, ["file"], "event_id", "_n")
    return stored(numbered.select("file", pos.alias("pos"), (pos + wrong).alias("value")), "records")


def size_texts(spark: SparkSession, sf: str) -> DataFrame:
    def text(units: list[str]) -> Column:
        unit = F.get(F.array(*map(F.lit, units)), (F.col("p_partkey") % 5).cast("int"))
        return F.concat(_text("p_size"), unit)

    return table(spark, sf, "part").select(
        F.col("p_brand").alias("grp"),
        "p_partkey",
        text(["KB", "mb", "GB", "B", ""]).alias("size_txt"),
        text(["ms", "s", "m", "H", ""]).alias("time_txt"),
    )


def layouts(spark: SparkSession, sf: str) -> DataFrame:
    """One layout per supplier, for the manifest generators."""
    key = F.col("s_suppkey")
    levels = F.concat_ws(",", _text(key % 3 + 1), _text(key % 2 + 1), _text(key % 4 + 1))
    return table(spark, sf, "supplier").select(
        key.alias("thread"),
        (key % 4 + 1).alias("subdirs"),
        (F.col("s_nationkey") + 1).cast("bigint").alias("files"),
        levels.alias("levels"),
    )


def layout_trees(spark: SparkSession, sf: str) -> DataFrame:
    return layouts(spark, sf).withColumn("dirs_per_level", sizes.split_ints(F.col("levels")))
