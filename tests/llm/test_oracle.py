"""The numbered queries against their DuckDB twins on whole tables."""

import duckdb
import pytest

from tallyspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, SF)
    twin = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in twin.description]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(twin.fetchall(), key=key)
