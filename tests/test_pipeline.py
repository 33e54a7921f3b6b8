import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark import run_audit
from tallyspark.functions import fixed_values as fv
from tallyspark.operators import reports
from tallyspark.plans.pipeline import save
from tallyspark.sources import store

HEADER = "Invoice #,Vendor Name,Invoice Amount,Transaction Date,Entry Date,Posting Timestamp,Description"
FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%B %d, %Y", "%d-%b-%Y", "%Y-%m-%dT%H:%M:%S"]


def adversarial_lines():
    """A messy ledger with at least one case for every rule."""
    rng = random.Random(1)
    lines, base = [], datetime(2023, 1, 2)

    def add(invoice, vendor, amount, date, entry=None, stamp=None, memo="m"):
        text = f"${amount:,.2f}" if rng.random() < 0.3 else f" {amount:.2f} "
        day = date.strftime(rng.choice(FORMATS))
        entry = (entry or date + timedelta(days=1)).strftime("%Y-%m-%d")
        stamp = (stamp or date.replace(hour=11)).strftime("%Y-%m-%d %H:%M:%S")
        lines.append(f'INV-{invoice},  {vendor} ,"{text}","{day}",{entry},{stamp},{memo}')

    for i in range(300):
        add(10000 + 3 * i, f"Vendor {i % 9}", round(rng.uniform(100, 9000), 2), base + timedelta(days=i % 250), memo=f"n{i}")
    day = base + timedelta(days=8)
    add(1, "Dup Co", 777.5, day, memo="a"), add(1, "Dup Co", 777.5, day, memo="b")
    add(2, "Twice Ltd", 888.25, day), add(3, "Twice Ltd", 888.25, day + timedelta(days=4))
    add(4, "Split SA", 30000, day), add(5, "Split SA", 30000, day)
    add(6, "Back AG", 10.5, day, entry=day + timedelta(days=90))
    add(7, "Night BV", 11.5, day, stamp=day.replace(hour=3))
    add(8, "Sat Inc", 12.5, datetime(2024, 1, 6)), add(9, "Xmas", 13.5, datetime(2023, 12, 25))
    add(10, "Sleepy", 14.5, datetime(2022, 1, 3)), add(11, "Sleepy", 15.5, datetime(2023, 1, 3))
    add(12, "Whale", 2900000.5, day)
    add(13, "", 16.5, day)
    add(14, "Copy", 17.5, day, memo="same"), add(14, "Copy", 17.5, day, memo="same")
    return lines


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "payments.csv"
    path.write_text("\n".join([HEADER, *adversarial_lines()]) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def run(spark, csv):
    return run_audit(spark, csv, "d1", dense=True)


def test_every_rule_fires(run):
    assert run.error is None
    rows = run.findings.collect()
    assert {r["rule_id"] for r in rows} == {r[0] for r in fv.RULES}
    assert all(0 <= r["risk_score"] <= 100 and r["audit_explanation"] and r["status"] == "PENDING" for r in rows)
    assert len({r["finding_id"] for r in rows}) == len(rows)


def test_counts_agree_with_rows(run):
    per_finding = run.finding_rows.groupBy("finding_key").agg(F.count(F.lit(1)).alias("n"))
    joined = run.findings.join(per_finding, "finding_key", "left").select("n_rows", F.coalesce("n", F.lit(0)).alias("n"))
    assert all(r["n_rows"] == r["n"] for r in joined.collect())


def test_ledger(run):
    lines = len(adversarial_lines())
    assert run.row_count == lines - 1  # one exact copy
    index = [r[0] for r in run.ledger.select("row_index").orderBy("row_index").collect()]
    assert index == list(range(lines - 1))
    steps = [r["step"] for r in run.cleaning_log.orderBy("seq").collect()]
    assert steps == ["normalize_nulls", "drop_duplicate_rows", "coerce_numeric", "coerce_date", "coerce_date", "coerce_date"]
    assert run.tables["profile_dataset"].first()["column_count"] == 7
    assert run.tables["summary"].first()[0].startswith(f"Analyzed {lines - 1} rows and raised ")


def test_enrichment_payload(run):
    payload = reports.enrichment_payload(run.findings, run.finding_rows, ["seq"])
    assert payload.count() == min(50, run.findings.count())


def test_rule_subset_and_mapping_override(spark, csv):
    out = run_audit(spark, csv, "d2", rule_ids=["ROUND_DOLLAR"])
    assert {r["rule_id"] for r in out.findings.collect()} == {"ROUND_DOLLAR"}
    out = run_audit(spark, csv, "d3", mapping={"date": "Entry Date"})
    assert "amount" not in out.ledger.columns
    assert {r["rule_id"] for r in out.findings.collect()} <= {"WEEKEND_POSTING", "PUBLIC_HOLIDAY_POSTING"}


def test_tiny_ledger_is_refused(spark, tmp_path):
    path = tmp_path / "tiny.csv"
    path.write_text("date,vendor,amount\n2024-05-07,Kiln,31.5\n2024-05-08,Loom,12\n")
    out = run_audit(spark, str(path), "tiny")
    assert "fewer than 10 rows" in out.error and out.findings is None


def test_save_rerun_delete(spark, run, csv, tmp_path):
    root = str(tmp_path / "store")
    save(run, root)
    other = run_audit(spark, csv, "d2", rule_ids=["THRESHOLD_BREACH", "ROUND_DOLLAR"])
    save(other, root)
    again = run_audit(spark, csv, "d1", rule_ids=["THRESHOLD_BREACH"])
    save(again, root)
    stored = store.read_table(spark, root, "findings")
    assert {(r["dataset_id"], r["rule_id"]) for r in stored.collect()} == {
        ("d1", "THRESHOLD_BREACH"), ("d2", "THRESHOLD_BREACH"), ("d2", "ROUND_DOLLAR"),
    }
    assert store.read_partition(spark, root, "ledger", "d1").count() == run.row_count
    store.write_partition(again.findings.filter("false"), root, "findings", "d1")  # a rerun may find nothing
    assert {r["dataset_id"] for r in store.read_table(spark, root, "findings").collect()} == {"d2"}
    store.write_partition(again.findings, root, "findings", "d1")
    reports.export_csv(store.read_table(spark, root, "findings"), f"{root}/export")
    assert spark.read.option("header", True).csv(f"{root}/export").columns == reports.EXPORT_COLUMNS
    store.delete_datasets(spark.createDataFrame([("d1",)], "dataset_id string"), root)
    assert {r["dataset_id"] for r in store.read_table(spark, root, "findings").collect()} == {"d2"}
    store.purge_dataset(spark, root, "d1", ["findings", "ledger"])
    store.write_partition(again.findings, root, "findings", "007")
    assert {r["dataset_id"] for r in store.read_table(spark, root, "findings").collect()} == {"d2", "007"}
    store.purge_dataset(spark, root, "007", ["findings"])
    assert store.read_table(spark, root, "findings").count() == 2
    again.discard(), other.discard()
