"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lakecairn.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert df.count() > 0
        return
    got = df.collect()
    rel = db.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    want = sorted([tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall()], key=repr)
    assert sorted([tuple(plain(r[c]) for c in names) for r in got], key=repr) == want
    # types as well: whole numbers, doubles, strings, flags
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    said = dict(df.dtypes)
    odd = {c: (said[c], str(t)) for c, t in zip(rel.columns, rel.types, strict=True) if kinds.get(str(t), str(t)) != said[c]}
    assert not odd
