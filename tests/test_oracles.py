"""Every query with SQL against DuckDB on the smallest tables, and a run of those without."""

import math
import os

import duckdb
import pytest

from lithic.plans import catalog

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return db


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    asked = duck.execute(catalog.ORACLE[name])
    names, kinds = [d[0] for d in asked.description], {d[0]: str(d[1]) for d in asked.description}
    assert sorted(df.columns) == sorted(names)
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    assert rows(df.columns, df.collect()) == rows(names, asked.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0
