"""The queries of the subpackage that have SQL give what DuckDB gives; all return their contract's columns."""

import duckdb
import pytest

from keyloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted evidence",
    "op2_simhash_dedup": "doc_id fingerprint component_id",
    "op3_quality": "doc_id held_out score predicted",
    "op4_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op5_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_html_extraction": "page_id url text n_chars",
    "op7_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_nearest_neighbours": "query_id rank vec_id score",
    "op10_source_mixing": "doc_id size source_size target taken",
    "op11_warc_archives": "page_id payload_bytes payload_digest record_type refers_to",
    "op12_spelling_variants": "word form root n n_near form_n",
    "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


def test_contract_columns(spark):
    assert queries.queries().keys() == COLUMNS.keys()
    for name, columns in COLUMNS.items():
        assert queries.queries()[name](spark, SF).columns == columns.split(), name


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in want.description]
    got = [tuple(r[c] for c in order) for r in queries.queries()[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
