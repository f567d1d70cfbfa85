"""Every registered query of the core against its SQL in DuckDB."""

import decimal

import duckdb
import pytest

from cairn.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(x):
    return repr(float(x)) if isinstance(x, (float, decimal.Decimal)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
