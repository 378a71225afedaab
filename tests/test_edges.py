"""Queries against their SQL on tables with edge rows: texts that end with a line break, undated groups."""

import os

import duckdb
import pytest
from test_queries import ORACLES, QUERIES, SF, rows

EDGES = {
    "documents": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'head | tail' || chr(10) WHEN 1 THEN 'head | tail' ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 17 < 2",
    "conversations": "SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'To bleerou.' || chr(10) WHEN 1 THEN 'a' || chr(13) || 'b.' || chr(13) || chr(10) ELSE text END AS text FROM conversations",
}


@pytest.fixture(scope="module")
def edge_dir(tmp_path_factory):
    path, c = tmp_path_factory.mktemp("edges"), duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{f}'")
        c.execute(f"COPY ({EDGES.get(name, f'SELECT * FROM {name}')}) TO '{path}/{f}' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["arc_chapters", "claim_wording", "clean_titles", "post_cleaning"])
def test_edge_rows_match_sql(spark, edge_dir, name):
    c = duckdb.connect()
    for f in os.listdir(edge_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{edge_dir}/{f}'")
    got, found = QUERIES[name](spark, edge_dir), c.execute(ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in found.description], found.fetchall())
