import re

import pytest

import __spark_entry__ as entry
from tests import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
OWN = sorted(n for n in QUERIES if re.match(r"op\d+_|pipeline$", n))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in OWN if n != "pipeline") == list(range(1, 14)) and "pipeline" in OWN


@pytest.mark.parametrize("name", [n for n in OWN if n in ORACLES])
def test_query_equals_sql(spark, sf, name):
    assert compare.differences(QUERIES[name](spark, sf), compare.connect(sf), ORACLES[name]) is None


FIRST = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_target_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
}


@pytest.mark.parametrize("name", sorted(FIRST))
def test_contract_columns_and_rows(spark, sf, documents, name):
    out = QUERIES[name](spark, sf)
    assert out.columns[: len(FIRST[name])] == FIRST[name]
    key, rows = ("page_id", spark.read.parquet(f"{sf}/pages.parquet")) if "page_id" in out.columns else ("doc_id", documents)
    assert sorted(r[0] for r in out.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())
