"""Every registered core query against its SQL on the smallest tables."""

import os

import pytest

from weftline import queries

SF = os.environ.get("WEFTLINE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got, columns = df.collect(), sorted(df.columns)
    assert got
    if name not in queries.ORACLE_SQL:
        return
    found = duck.execute(queries.ORACLE_SQL[name])
    names, rows = [d[0] for d in found.description], found.fetchall()
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got) == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rows)


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() >= 1
