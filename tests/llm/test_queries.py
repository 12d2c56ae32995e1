"""The registered queries over the smallest tables: columns, and digests against plain Python."""

import hashlib

import duckdb
import pytest

from stretto.llm import queries

from .test_pii import plain_base

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ppm": "doc_id held_out n_tokens n_known train_tokens base_score score", "op2_mix": "doc_id size source_size target taken", "op3_topk": "query_id rank vec_id score", "op4_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_toxicity": "doc_id p_toxic is_toxic", "op6_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op7_simhash": "doc_id fingerprint component_id", "op8_repair": "doc_id start n_tokens ids_crc32",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op10_vectors": "vec_id n_links component_id kept", "pipeline": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    got = queries.queries()[name](spark, SF)
    assert got.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split() or set(COLUMNS[name].split()) <= set(got.columns)
    rows = got.collect()
    table = "embeddings" if name in ("op3_topk", "op10_vectors") else "documents"
    if name not in ("op3_topk", "pipeline"):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name == "op6_pii":
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        for r in rows:
            base = plain_base(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{i}:{j}" for k, i, j in base).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in ("email", "ip", "card", "phone")]
            assert {f"{k}:{i}:{j}" for k, i, j in base} <= set(r.spans.split(","))  | ({""} if not base else set())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want
