"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Queries of the corpus subpackage have tests of their own and whole tables to read; here they only must run.
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in SQL:
        assert rows
        return
    found = oracle.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
