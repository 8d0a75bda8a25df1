"""Corpus queries against their SQL, and the columns that they promise."""

import os

import duckdb
import pytest

from citeloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_main_text": {"page_id", "url", "text", "n_chars"},
    "op3_similarity_join": {"vec_id", "n_links", "component_id", "kept"},
    "op4_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5_token_counts": {"source", "lang", "tokenizer", "docs", "tokens", "chars"},
    "op6_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op7_quality": {"doc_id", "held_out", "score", "predicted"},
    "op8_lm_scoring": {"doc_id", "n_words", "log_likelihood", "mean_log_likelihood"},
    "op9_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_substring_dedup": {"doc_id", "n_chunks", "n_duplicate_chunks", "bytes_removed", "repeated"},
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(got.columns)
    rows = got.collect()
    if name != "op5_token_counts":
        table = "pages" if name == "op2_main_text" else "embeddings" if name == "op3_similarity_join" else "documents"
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.ORACLES:
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
        rel = c.sql(queries.ORACLES[name])
        assert sorted(rel.columns) == sorted(got.columns)
        plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        assert sorted(tuple(plain(r[k]) for k in rel.columns) for r in rows) == sorted(tuple(map(plain, r)) for r in rel.fetchall())
