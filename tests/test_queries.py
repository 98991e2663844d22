"""Every query of the catalogue runs on small data and agrees with its SQL."""

import os

import pytest

from sphaera.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return float(f"{v:.6g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=str)
    assert got == want


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
