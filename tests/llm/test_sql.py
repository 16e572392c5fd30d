"""The queries that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from lakecairn.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = db.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall())
