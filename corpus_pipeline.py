"""A corpus pipeline of training-data operators: grade, dedupe, cut repeats, decontaminate, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import contamination, jaccard, ordinal, repeats, wordtable
from lakeaudit.llm.common import parted, stored, table, without
from lakeaudit.llm.pieces import default_path


#: Bytes of text that are sorted at once: other stages' memory lies beside it.
_SHARD = 1 << 20


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches, so that what an executor holds beside its heap stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the top grade; poor and toxic ones go."""
    _small_batches(spark)
    return ordinal.select(docs, ordinal.fit(docs, ordinal.grades_of(table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id; of repeated rows one; rows of null id stay."""
    _small_batches(spark)
    found = stored(jaccard.ngram_jaccard_join(docs), "pipeline-classes")
    kept = without(docs, found.where("doc_id <> class_id").select("doc_id").distinct())
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    maybe, rest = parted(kept, F.xxhash64("doc_id"), again.select(F.xxhash64("doc_id").alias("k")), "k")
    return rest.unionByName(maybe.dropDuplicates(["doc_id", "text"]))


def byte_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes (about 40 words) that stand anywhere else; characters that are cut in two go whole."""
    _small_batches(spark)
    removed = repeats.remove_repeats(docs, shard=_SHARD).where(F.size("spans") > 0)
    changed = stored(removed.select("doc_id", "h", "kept").withColumn("new", repeats.as_text("kept")).drop("kept").distinct(), "pipeline-cut")
    changed = changed.withColumnsRenamed({"doc_id": "c_id", "h": "c_h"})
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    maybe, rest = parted(docs, F.xxhash64("doc_id", h), changed.select(F.xxhash64("c_id", "c_h").alias("k")), "k")
    cut = maybe.withColumn("_h", h).join(changed, (F.col("_h") == F.col("c_h")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left")
    cut = cut.withColumn("n_chars", F.when(F.col("new").isNull(), F.col("n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType)))
    return rest.unionByName(cut.withColumn("text", F.coalesce("new", "text")).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item and held none before repeats were cut, which may leave half an item."""
    _small_batches(spark)
    before = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.contaminated(docs.select("doc_id", "text").unionByName(before), table(spark, sf_dir, "benchmark"))
    return without(docs, stored(found.select("doc_id").distinct(), "pipeline-leaks"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    _small_batches(spark)
    path = default_path()
    return wordtable.digest(wordtable.decode_ids(wordtable.encode_texts(docs, path), path))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", byte_repeats),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: The classifier is fitted, so SQL can't express the result; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
