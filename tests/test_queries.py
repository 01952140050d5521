"""Every query with an SQL counterpart gives the same rows and types as DuckDB."""

import duckdb
import pytest

from reviewrec.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    types = {d[0]: str(d[1]) for d in found.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    names = [d[0] for d in found.description]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(key, df.select(*names).collect())) == sorted(map(key, found.fetchall()))
