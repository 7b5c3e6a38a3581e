"""The queries' columns and, where there is one, their SQL twin; the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from conftest import SF
from tallyloom.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op2_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op3_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op5_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op7_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op9_token_shards": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op10_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    rows = df.count()
    assert rows == spark.read.parquet(f"{SF}/documents.parquet").count() or name == "op8_decontaminate"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    order = sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    assert order == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() and (docs.columns == columns or i == 4)
        if i < 3:
            assert docs.count() <= before and docs.select("doc_id").distinct().count() == docs.count()
            before = docs.count()
    assert docs.count() == spark.read.parquet(str(tmp_path / "mix_sources")).count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count() and corpus_pipeline.ORACLE_SQL is None
