"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from stratalake import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES = registry.all_queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, duck, name):
    df = QUERIES[name].run(spark, SF)
    rel = duck.sql(QUERIES[name].sql)
    assert sorted(df.columns) == sorted(rel.columns)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {f.name: KINDS.get(f.dataType.simpleString()) for f in df.schema.fields} == kinds
    cols = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(str(plain(r[i])) for i in at) for r in rel.fetchall())
    assert got == want
    assert got, "the query has no rows here"


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0
