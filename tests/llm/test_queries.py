import duckdb
import pytest

from graphloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_sql(spark, name, folder):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(x) for x in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
