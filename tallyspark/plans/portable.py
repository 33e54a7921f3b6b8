"""Test ledgers, findings and reviews derived from the given tables, in SQL that Spark and DuckDB both run.

Whole tables are used throughout; extra rows are added where the tables hold no
duplicates or repeated postings.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

LEDGER = """
base AS (
 SELECT o.o_orderkey AS row_index,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL
       ELSE concat('INV-', CAST(100000 + o.o_orderkey AS STRING)) END AS invoice_no,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_custkey % 9 < 4 THEN 'Mega Vendor' ELSE c.c_name END AS vendor,
  CASE WHEN o.o_orderkey % 89 = 0 THEN NULL WHEN o.o_orderkey % 83 = 0 THEN -o.o_totalprice
       ELSE o.o_totalprice END AS amount,
  o.o_orderdate AS date,
  o.o_orderdate + (o.o_orderkey % 41) * INTERVAL '1' DAY AS entry_date,
  o.o_orderdate + (o.o_orderkey % 24) * INTERVAL '1' HOUR AS timestamp
 FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey),
ledger AS (
 SELECT * FROM base
 UNION ALL SELECT row_index + 100000000, invoice_no, vendor, amount, date, entry_date, timestamp
   FROM base WHERE row_index % 101 = 0
 UNION ALL SELECT row_index + 200000000, concat('INV-', CAST(900000 + row_index AS STRING)), vendor, amount,
   date + (row_index % 9) * INTERVAL '1' DAY, entry_date, timestamp
   FROM base WHERE row_index % 103 = 0)"""

# Invoice numbers of 38 and 45 digits, amounts that no decimal of a ledger holds, and eight decimals.
EXTREME = LEDGER + """,
extreme AS (
 SELECT row_index,
  CASE WHEN row_index % 501 = 1 THEN concat('INV-', repeat('9', 38)) WHEN row_index % 501 = 2 THEN concat('N', '1', repeat('0', 44))
       ELSE invoice_no END AS invoice_no,
  CASE WHEN row_index % 303 = 3 THEN 'Vast' WHEN row_index % 303 = 4 THEN 'Fine' ELSE vendor END AS vendor,
  CASE WHEN row_index % 303 = 3 THEN CAST('1e23' AS DOUBLE) WHEN row_index % 303 = 4 THEN CAST('0.12345678' AS DOUBLE) + row_index
       ELSE amount END AS amount,
  date, entry_date, timestamp
 FROM ledger)"""

RAW = """
s AS (SELECT o_orderkey k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) a,
             CAST(CAST(o_orderdate AS DATE) AS STRING) d, o_orderpriority p FROM orders),
t AS (SELECT *, substr(d,1,4) yyyy, substr(d,3,2) yy, substr(d,6,2) mm, substr(d,9,2) dd,
  substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(substr(d,6,2) AS INT) * 3 - 2, 3) mon FROM s),
once AS (SELECT k AS row_index,
 CASE WHEN k % 50 = 7 THEN 'N/A' WHEN k % 50 = 9 THEN '--'
      WHEN k % 7 = 0 THEN concat('$', a) WHEN k % 7 = 1 THEN concat('($', a, ')')
      WHEN k % 7 = 2 THEN concat('  ', a, ' ') WHEN k % 70 = 3 THEN concat('-', a) ELSE a END AS amount_raw,
 CASE WHEN k % 60 = 11 THEN 'null'
      WHEN k % 61 = 1 THEN concat(mm,'/',dd,'/',yy) WHEN k % 61 = 2 THEN concat(mm,'/',dd,'/',yyyy,' 8:30 AM')
      WHEN k % 61 = 3 THEN concat(d,' 08:30:15 PM') WHEN k % 61 = 4 THEN concat(dd,'-',mon,'-',yy)
      WHEN k % 61 = 5 THEN concat(dd,' ',mon,' ',yy) WHEN k % 61 = 6 THEN concat(mon,' ',dd,', ',yyyy,' 08:30')
      WHEN k % 61 = 7 THEN concat(yyyy,'.',mm,'.',dd) WHEN k % 61 = 8 THEN concat(mm,'.',dd,'.',yyyy)
      WHEN k % 61 = 9 THEN concat('Fri, ',dd,' ',mon,' ',yyyy) WHEN k % 61 = 10 THEN concat('Wednesday,',repeat(' ',50),dd,' ',mon,' ',yyyy)
      WHEN k % 4 = 0 THEN d
      WHEN k % 4 = 1 THEN concat(substr(d,6,2),'/',substr(d,9,2),'/',substr(d,1,4))
      WHEN k % 4 = 2 AND CAST(substr(d,9,2) AS INT) > 12 THEN concat(substr(d,9,2),'/',substr(d,6,2),'/',substr(d,1,4))
      ELSE concat(d,'T08:30:00') END AS date_raw,
 CASE WHEN k % 40 = 0 THEN '=SUM(A1:A10)' WHEN k % 45 = 0 THEN '@SUM(1)' ELSE concat(' ', p, '  ') END AS memo_raw
 FROM t),
raw AS (SELECT * FROM once
 UNION ALL SELECT row_index + 100000000, amount_raw, date_raw, memo_raw FROM once WHERE row_index % 30 = 0)"""

FINDINGS = """
findings AS (
 SELECT o_orderkey AS finding_no, concat('FND-', CAST(o_orderkey AS STRING)) AS finding_id, o_custkey AS dataset_id,
  concat('RULE_', CAST(o_orderkey % 15 AS STRING)) AS rule_id,
  concat('Rule number ', CAST(o_orderkey % 15 AS STRING)) AS rule_name,
  CASE WHEN o_orderkey % 15 < 6 THEN 'HIGH' WHEN o_orderkey % 15 < 14 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  o_orderkey % 40 AS n_rows,
  concat('Order in status ', o_orderstatus, ' with priority ', o_orderpriority) AS audit_explanation,
  CASE WHEN o_orderkey % 15 = 0 THEN o_totalprice END AS total_exposure,
  CASE WHEN o_orderkey % 15 = 0 THEN 2 + o_orderkey % 4 END AS duplicate_count,
  CASE WHEN o_orderkey % 15 = 11 THEN CAST(o_orderkey % 60 AS DOUBLE) / 1000 END AS p_value,
  CASE WHEN o_orderkey % 15 = 13 THEN 40 + o_orderkey % 50 END AS concentration_pct,
  CAST(NULL AS DOUBLE) AS threshold_pct,
  CASE WHEN o_orderkey % 15 = 2 THEN o_orderkey % 40 END AS gap_pct
 FROM orders),
reviews AS (
 SELECT event_id AS id, concat('FND-', CAST(user_id AS STRING)) AS finding_id,
  CASE event_type WHEN 'purchase' THEN 'CONFIRM' WHEN 'error' THEN 'DISMISS' ELSE 'NOTE' END AS action,
  ts AS created_at
 FROM events),
datasets AS (
 SELECT c.c_custkey AS dataset_id, concat(c.c_name, '.csv') AS dataset_name, min(o.o_orderdate) AS created_at
 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name)"""

# Sixteen columns per dataset; one dataset in five has mistyped columns.
COLUMNS = """
named AS (
 SELECT CAST(floor(o_orderkey / 16) AS BIGINT) AS dataset_id, o_orderkey AS ordinal, o_custkey % 5 AS flavour,
  CASE o_orderkey % 16
   WHEN 0 THEN 'Vendor Name' WHEN 1 THEN 'Invoice Amount' WHEN 2 THEN 'Transaction Date' WHEN 3 THEN 'Entry Date'
   WHEN 4 THEN 'Posting Timestamp' WHEN 5 THEN 'Invoice #' WHEN 6 THEN 'net_amount' WHEN 7 THEN 'payee'
   WHEN 8 THEN 'posting_date' WHEN 9 THEN 'document_date' WHEN 10 THEN 'memo' WHEN 11 THEN 'Department'
   WHEN 12 THEN 'Total Cost' WHEN 13 THEN 'inv_no' WHEN 14 THEN 'Party' ELSE 'datetime' END AS name
 FROM orders),
columns_of AS (
 SELECT dataset_id, ordinal, name,
  CASE WHEN flavour = 0 THEN 'text'
       WHEN name IN ('Invoice Amount', 'net_amount', 'Total Cost') THEN 'numeric'
       WHEN name IN ('Transaction Date', 'Entry Date', 'posting_date', 'document_date', 'datetime') THEN 'date'
       ELSE 'text' END AS type
 FROM named)"""


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; kept per session so its schema is read once."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, ctes: str, select: str) -> DataFrame:
    """Run `WITH ctes select` over the tables it names."""
    for name in TABLES:
        if f" {name}" in ctes:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(f"WITH {ctes} {select}")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, LEDGER, "SELECT * FROM ledger")


def extreme_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, EXTREME, "SELECT * FROM extreme")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, RAW, "SELECT * FROM raw")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, FINDINGS, "SELECT * FROM findings")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, FINDINGS, "SELECT * FROM reviews")


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, FINDINGS, "SELECT * FROM datasets")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, COLUMNS, "SELECT dataset_id, ordinal, name AS column, type FROM columns_of")
