"""Every registered query against its DuckDB oracle on the sf0.001 tables."""
import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from tablewise.plans import registered
from tablewise.session import TABLES

SF_SMALL = "/root/testdata/sf0.001"
ORACLE = registered.ORACLE
QUERIES = registered.QUERIES


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "value"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows and len(rows[0]) == len(set(df.columns))
        return
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, rows) == _canon(dcols, cur.fetchall())


def test_every_query_has_an_oracle_except_array_profiles():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"profile_orders", "profile_documents", "schema_from_profile_customer"}
    assert set(ORACLE) <= set(QUERIES)
