"""Every registered query against its DuckDB twin, and the fixture counts."""

import decimal
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tallyspark.operators import findings as fnd
from tallyspark.plans import portable
from tallyspark.plans.catalogue import QUERIES
from tallyspark.plans.oracle import ORACLE_SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in portable.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6)
        return str(v) if hasattr(v, "isoformat") else v

    out = [[cell(r[i]) for i in order] for r in rows]
    return [columns[i] for i in order], sorted(out, key=str)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(queries()) and set(ORACLE_SQL) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLE_SQL[name])
    assert got == normal([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and [r["seq"]["rule"] for r in rows] == sorted(r["seq"]["rule"] for r in rows)


def test_fixture_counts(spark):
    ledger = fnd.narrow(portable.ledger(spark, "/root/testdata/sf0.01"))
    counts = {r["rule_id"]: r["n_rows"] for r in fnd.findings(ledger, fnd.ROW_RULES).collect()}
    assert counts == {
        "MISSING_REQUIRED_FIELD": 1469, "WEEKEND_POSTING": 4416, "PUBLIC_HOLIDAY_POSTING": 198, "AFTER_HOURS_ENTRY": 7648,
        "BACKDATED_ENTRY": 3709, "ROUND_DOLLAR": 166, "THRESHOLD_BREACH": 13656,
    }
