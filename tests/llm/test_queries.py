"""Registered queries: DuckDB parity where SQL can say it, else row counts and declared columns."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracle import rows_of  # noqa: E402

from tabsmith.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize(("name", "table", "per_row", "columns"), [
    ("op1_html", "pages", 1, {"page_id", "url", "text", "n_chars"}),
    ("op2_minhash", "documents", 1, {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}),
    ("op3_packing", "documents", 1, {"doc_id", "bucket", "batch"}),
    ("op4_warc", "pages", 2, {"record_id", "refers_to", "block_digest"}),
    ("op5_pii", "documents", 1, {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}),
    ("op6_ngram_join", "documents", 1, {"doc_id", "n_shingles", "component_id"}),
    ("op8_lattice", "embeddings", 1, {"vec_id", "n_links", "component_id", "kept"}),
    ("op9_toxicity", "documents", 1, {"doc_id", "held_out", "score", "predicted"}),
])
def test_covers_the_whole_table(spark, name, table, per_row, columns):
    df = queries.QUERIES[name](spark, SF)
    assert columns <= set(df.columns)
    assert df.count() == per_row * spark.read.parquet(f"{SF}/{table}.parquet").count()
