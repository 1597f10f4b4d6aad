"""The operator queries against their SQL twins, and the contract's columns."""

import pytest

from lakeaudit.llm.oracle import ORACLE
from lakeaudit.llm.queries import QUERIES
from tests.compare import check, duck

COLUMNS = {
    "op1_chat_formatting": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op3_topk_search": {"query_id", "rank", "vec_id", "score"},
    "op7_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op10_byte_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op11_passage_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op12_periodic_runs": {
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    },
}


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, sf, key):
    assert check(spark, duck(sf), sf, key, QUERIES[key], ORACLE[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_a_row_for_each_document(spark, sf, key):
    rows = QUERIES[key](spark, sf)
    assert COLUMNS.get(key, set()) <= set(rows.columns)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_native_queries_run_no_python(spark, sf):
    for key in ("op1_chat_formatting", "op9_license_scan"):
        plan = QUERIES[key](spark, sf)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
