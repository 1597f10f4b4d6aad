import pytest
from pyspark.sql import functions as F

from lakeaudit.functions import paths, sizes
from lakeaudit.functions.numbers import div


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_parse_size(spark):
    texts = ["10KB", " 10kb\t", "3", "3B", "2mb", "1GB", "-5KB", "+5", "10 KB", "1.5MB", "", "KB",
             "9999999999GB", "99999999999999999999", "7TB", None]
    assert values(spark, texts, sizes.parse_size) == [
        10240, 10240, 3, 3, 2 << 20, 1 << 30, -5120, 5, None, None, None, None, None, None, None, None]


def test_parse_time(spark):
    texts = ["10ms", "7", "7s", "2m", " 1H ", "1d", "", "s", None]
    assert values(spark, texts, sizes.parse_time) == [
        10, 7000, 7000, 120_000, 3_600_000, None, None, None, None]


@pytest.mark.parametrize("n, text", [
    (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1024**2 - 1, "1024.00 KB"),
    (1024**2, "1.00 MB"), (5 * 1024**3 // 2, "2.50 GB"), (1029, "1.00 KB"), (1030, "1.01 KB"),
])
def test_format_size(spark, n, text):
    assert spark.range(1).select(sizes.format_size(F.lit(n).cast("bigint"))).first()[0] == text


def test_format_time(spark):
    out = [spark.range(1).select(sizes.format_time(F.lit(n).cast("bigint"))).first()[0]
           for n in (999, 1000, 1005, 90_000, 5_400_000)]
    assert out == ["999 毫秒", "1.00 秒", "1.01 秒", "1.50 分钟", "1.50 小时"]
    plain = sizes.format_time(F.lit(90_000).cast("bigint"), ("h", "min", "s", "ms"))
    assert spark.range(1).select(plain).first()[0] == "1.50 min"
    assert spark.range(1).select(sizes.format_time(F.lit(None).cast("bigint"))).first()[0] is None


def test_split_ints(spark):
    assert values(spark, ["3,2, 4", "x,1", "5"], sizes.split_ints) == [[3, 2, 4], [None, 1], [5]]


def test_paths(spark):
    texts = ["", "a", "a/b", "a/b/c"]
    assert values(spark, texts, paths.parent_of) == [None, "", "a", "a/b"]
    assert values(spark, texts, paths.name_of) == ["", "a", "b", "c"]
    assert values(spark, texts, paths.depth_of) == [0, 1, 2, 3]
    assert values(spark, texts, paths.segments_of) == [[], ["a"], ["a", "b"], ["a", "b", "c"]]
    assert values(spark, texts, paths.ancestors_of) == [[], [""], ["", "a"], ["", "a", "a/b"]]


def test_cuts(spark):
    assert values(spark, ["/r/a/b", "/r"], lambda c: paths.rel_path(c, "/r")) == ["/a/b", ""]
    assert values(spark, ["hdfs://h/a", "file:/a", "/a:b"], paths.strip_scheme) == ["//h/a", "/a", "/a:b"]


def test_dfs_key_is_segment_order(spark):
    texts = ["a", "a/b", "a-b", "a/b/c", "a.b", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    by_key = [r[0] for r in df.orderBy(paths.dfs_key(F.col("t"))).collect()]
    assert by_key == sorted(texts, key=lambda t: t.split("/"))


def test_div_keeps_large_numbers(spark):
    big = 2**62 + 1
    assert spark.range(1).select(div(F.lit(big).cast("bigint"), 1)).first()[0] == big
