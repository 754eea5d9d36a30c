"""The registered queries: rows as in DuckDB where there is SQL, and the columns that were agreed on."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from pricetide.llm import queries as Q  # noqa: E402

COLUMNS = {
    "op1": ["doc_id:bigint", "n_shingles:bigint", "component_id:bigint"],
    "op2": ["doc_id:bigint", "n_assign:bigint", "n_access:bigint", "n_hex:bigint", "base_sha256:string", "spans:string"],
    "op3": ["query_id:bigint", "rank:int", "vec_id:bigint", "score:bigint"],
    "op5": ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"],
    "op6": ["doc_id:bigint", "held_out:boolean", "lang_pred:string", "score:double"],
    "op7": ["doc_id:bigint", "n_words:bigint", "word_chars:bigint", "n_symbols:bigint", "n_dup_lines:bigint", "n_repeat_words:bigint", "base_failed:boolean", "kept:boolean"],
    "op8": ["doc_id:bigint", "size:bigint", "text_crc32:bigint", "law:string", "shard:int", "slot:bigint", "grown_shard:int"],
    "op9": ["doc_id:bigint", "start:bigint", "length:bigint", "ids_crc32:bigint", "doc_tokens:bigint", "sequence_id:bigint", "offset:bigint"],
    "op10": ["page_id:bigint", "payload_bytes:bigint", "payload_digest:string", "record_type:string", "refers_to:bigint"],
    "op11": ["doc_id:bigint", "n_lines:bigint", "n_dropped:bigint", "kept_sha256:string"],
    "op12": ["conv_id:bigint", "gaps:bigint", "blank:bigint", "duplicate:bigint", "truncated:bigint", "illegal:bigint", "cost:bigint", "audit:string", "repaired_sha256:string"],
    "op13": ["conv_id:bigint", "depth:bigint", "parent_conv_id:bigint", "n_convs:bigint", "n_children:bigint", "n_leaves:bigint", "saved_tokens:bigint", "ends_sha256:string"],
}


@pytest.mark.skipif(not oracle.there(), reason="needs the test tables")
@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, name):
    run = Q.queries()[name]
    if name in Q.oracle_sql():
        oracle.compare(spark, run, Q.oracle_sql()[name])
    df = run(spark, oracle.FOLDER)
    assert [f"{c}:{t}" for c, t in df.dtypes][: len(COLUMNS.get(name.split("_")[0], []))] == COLUMNS.get(name.split("_")[0], [])
    assert df.count() > 0
