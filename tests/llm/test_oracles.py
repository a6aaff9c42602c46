"""The registered queries against SQL on the smallest tables."""
import duckdb
import pytest

from tablewise.llm.registered import ORACLE, QUERIES
from tablewise.session import TABLES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(cur.fetchall())
    assert want and sorted(tuple(r) for r in df.select(*columns).collect()) == want


def test_query_names():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}
