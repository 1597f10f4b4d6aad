"""The operators as registered queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import (
    chat, contamination, edits, jaccard, licenses, order, ordinal, passages, periods, phrases, repeats, topk, wordtable,
)
from lakeaudit.llm.common import table
from lakeaudit.llm.pieces import default_path
from lakeaudit.session import new_path

#: Added to the conversations: turns that say control strings.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.examples(turns.unionByName(spark.createDataFrame(CONTROL_TURNS, turns.schema))))


def edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits made from each one's own columns."""
    path = default_path()
    docs = table(spark, sf_dir, "documents")
    trees = edits.build_trees(docs, path)
    n, id_ = F.length("text").cast("long"), F.coalesce(F.col("doc_id"), F.lit(0))
    at = F.pmod(F.xxhash64(id_), F.greatest(n, F.lit(1)))
    change = lambda start, stop, insert: F.struct(start.alias("start"), stop.alias("stop"), insert.alias("insert"))
    own = F.array(
        change(at, at + 7, F.concat(F.lit(" edit "), id_.cast("string"))),
        change(F.floor(n / 3), F.floor(n / 3) + 40, F.lit("")),
        change(n, n, F.substring("text", 1, 30)),
    )
    done = edits.apply_edits(trees.withColumn("edits", own), path)
    return done.select("doc_id", "n_edits", "tokens_before", "tokens_after", "recounted", F.sha2("text", 256).alias("text_sha256"))


def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0), 5)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.materialise(table(spark, sf_dir, "documents"), default_path(), new_path(spark, "training-order"), key=20_24)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.grade(docs, ordinal.fit(docs, ordinal.grades_of(table(spark, sf_dir, "labels"))))


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    return wordtable.digest(wordtable.decode_ids(wordtable.encode_texts(table(spark, sf_dir, "documents"), path), path))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's strings of 400 bytes; the operator's own length is shorter."""
    return repeats.outcome(repeats.remove_repeats(table(spark, sf_dir, "documents"), 400))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(passages.remove_passages(table(spark, sf_dir, "documents")))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, after about every tenth one's tail was made periodic."""
    return periods.digest(periods.periodic_runs(periods.with_periods(table(spark, sf_dir, "documents"))))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat_formatting,
    "op2_edited_counts": edited_counts,
    "op3_topk_search": topk_search,
    "op4_training_order": training_order,
    "op5_decontamination": decontamination,
    "op6_quality": quality,
    "op7_bpe": bpe,
    "op8_ngram_jaccard": near_duplicates,
    "op9_license_scan": license_scan,
    "op10_byte_repeats": byte_repeats,
    "op11_passage_dedup": passage_dedup,
    "op12_periodic_runs": periodic_runs,
    "op13_collocations": collocations,
}
