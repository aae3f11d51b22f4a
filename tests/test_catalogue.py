"""Every catalogue query against its SQL, on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()
SQL = catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf, duck):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    assert rows
    if name in SQL:
        cur = duck.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=repr)
        assert rows == want


def test_only_queries_have_sql():
    assert set(SQL) <= set(catalogue.queries())


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
