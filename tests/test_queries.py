"""Every registered query against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from decispark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert got
        return
    expected = oracle.sql(registry.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    assert got == ordered(tuple(plain(r[i]) for i in places) for r in expected.fetchall())
