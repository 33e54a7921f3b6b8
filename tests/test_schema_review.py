import random
from datetime import datetime

import pytest

from tallyspark.functions import fixed_values as fv
from tallyspark.operators import reports, review, schema
from tallyspark.sources import store

KINDS = {"text": "string", "numeric": "double", "date": "timestamp_ntz"}


def mapping(spark, columns):
    ddl = ", ".join(f"`{name}` {KINDS[kind]}" for name, kind in columns)
    return schema.infer_mapping(spark.createDataFrame([], ddl))


def test_mapping_of_the_sample_files(spark):
    t, n, d = "text", "numeric", "date"
    payments = [("Invoice #", t), ("Vendor Name", t), ("Invoice Amount", n), ("Transaction Date", d), ("Entry Date", d),
                ("Posting Timestamp", d), ("Description", t), ("Department", t)]
    assert mapping(spark, payments) == {
        "vendor": "Vendor Name", "amount": "Invoice Amount", "date": "Transaction Date", "invoice_no": "Invoice #",
        "entry_date": "Entry Date", "timestamp": "Posting Timestamp",
    }
    journal = [("je_number", t), ("payee", t), ("net_amount", n), ("posting_date", d), ("document_date", d), ("memo", t)]
    assert mapping(spark, journal) == {
        "vendor": "payee", "amount": "net_amount", "date": "posting_date", "entry_date": "document_date",
    }
    stress = [("invoice_no", t), ("vendor_name", t), ("amount", n), ("transaction_date", d), ("entry_date", d), ("timestamp", d),
              ("product_category", t), ("region", t), ("payment_method", t), ("quantity", n)]
    assert mapping(spark, stress) == {
        "vendor": "vendor_name", "amount": "amount", "date": "transaction_date", "invoice_no": "invoice_no",
        "entry_date": "entry_date", "timestamp": "timestamp",
    }
    assert mapping(spark, [("foo", t), ("bar", n)]) == {}


def test_scores(spark):
    columns = [("d", c, i, kind) for i, (c, kind) in enumerate([
        ("Invoice #", "text"), ("Vendor Name", "text"), ("Invoice Amount", "numeric"), ("Entry Date", "date"), ("invoice_no", "text"),
    ])]
    df = spark.createDataFrame(columns, "dataset_id string, column string, ordinal bigint, type string")
    scores = {(r["role"], r["column"]): r["score"] for r in schema.role_candidates(df).collect()}
    assert scores[("invoice_no", "Invoice #")] == 98 and scores[("invoice_no", "Invoice Amount")] == 93
    assert scores[("vendor", "Vendor Name")] == 95 and scores[("amount", "Invoice Amount")] == 92
    assert scores[("entry_date", "Entry Date")] == 150 and scores[("invoice_no", "invoice_no")] == 97


def test_greedy_assignment_against_brute_force(spark):
    rng = random.Random(11)
    roles = list(fv.ROLE_TYPES)
    rows, expected = [], set()
    for dataset in range(40):
        items = [(role, i, f"c{col}", col, rng.randint(80, 84)) for i, role in enumerate(roles) for col in range(6) if rng.random() < 0.5]
        rows += [(dataset, role, i, name, col, score) for role, i, name, col, score in items]
        used_roles, used_columns = set(), set()
        for role, i, name, col, score in sorted(items, key=lambda t: (-t[4], t[1], t[3])):
            if role not in used_roles and name not in used_columns:
                used_roles.add(role), used_columns.add(name)
                expected.add((dataset, role, name, score))
    df = spark.createDataFrame(rows, "dataset_id int, role string, role_order int, column string, ordinal bigint, score int")
    assert {tuple(r) for r in schema.assign_roles(df).collect()} == expected


def test_apply_mapping_and_name_collisions(spark):
    df = spark.createDataFrame([(0, "a", 1.0, "x")], "row_index bigint, Vendor string, total double, Amount string")
    out = schema.apply_mapping(df, {"vendor": "Vendor", "amount": "total"})
    assert out.columns == ["row_index", "vendor", "total", "Amount_source", "amount"]
    assert out.select("amount").first()[0] == 1.0
    kept = schema.apply_mapping(df.withColumnRenamed("total", "date"), {"date": "Amount"})
    assert kept.select("date").first()[0] == 1.0  # an existing column of that name stays


def test_gate(spark):
    rows = [("ok", 10, 3, 1), ("few", 9, 3, 1), ("none", 9, 0, 0)]
    df = spark.createDataFrame(rows, "dataset_id string, row_count int, column_count int, role_count int")
    got = {r["dataset_id"]: r["error"] for r in schema.quality_gate(df).collect()}
    assert got["ok"] is None and got["few"] == fv.GATE_FEW_ROWS
    assert got["none"] == "; ".join([fv.GATE_FEW_ROWS, fv.GATE_NO_COLUMNS, fv.GATE_NO_ROLES])


@pytest.fixture(scope="module")
def found(spark):
    rows = [("F1", "d1", "Rule B", "LOW", 30, 2, "late entries"), ("F2", "d1", "Rule A", "HIGH", 85, 1, "Backdated"),
            ("F3", "d2", "Rule A", "HIGH", 90, 5, "x"), ("F4", "d3", "Rule C", "MEDIUM", 60, 0, "y"), ("F5", "d3", "Rule B", "LOW", 35, 7, "z")]
    return spark.createDataFrame(
        rows, "finding_id string, dataset_id string, rule_name string, severity string, risk_score int, n_rows bigint, audit_explanation string"
    )


@pytest.fixture(scope="module")
def log(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("1", "F1", "confirm", at(1)), ("2", "F1", "DISMISS", at(2)), ("3", "F1", "NOTE", at(3)),
            ("4", "F2", "CONFIRM", at(1)), ("5", "F3", "NOTE", at(1)), ("6", "F4", "APPROVE", at(1)), ("7", "F4", None, at(2))]
    return spark.createDataFrame(rows, "id string, finding_id string, action string, created_at timestamp_ntz")


def test_review_fold(found, log):
    status = {r["finding_id"]: r["status"] for r in review.current_status(found, log).collect()}
    assert status == {"F1": "DISMISSED", "F2": "CONFIRMED", "F3": "PENDING", "F4": "PENDING", "F5": "PENDING"}
    assert {r["id"] for r in review.refused_actions(log).collect()} == {"6", "7"}
    assert {r["finding_id"] for r in review.pending(found, log).collect()} == {"F3", "F4", "F5"}
    assert [r["id"] for r in review.history(log, "F1").collect()] == ["1", "2", "3"]


def test_bulk_review(spark, found):
    chosen = spark.createDataFrame([("F1",), ("F1",), ("nope",)], "finding_id string")
    rows = review.bulk_review(found, chosen, "dismiss", "me").collect()
    assert [(r["finding_id"], r["action"], r["reviewer"]) for r in rows] == [("F1", "DISMISS", "me")]
    with pytest.raises(ValueError):
        review.bulk_review(found, chosen, "approve")


def test_reports(spark, found, log):
    names = spark.createDataFrame([("d1", "Alpha.csv"), ("d2", "Beta.csv")], "dataset_id string, dataset_name string")
    full = review.with_status(found, log)
    assert [r["finding_id"] for r in reports.ranked(found).collect()] == ["F3", "F2", "F4", "F5", "F1"]
    assert [r["finding_id"] for r in reports.ranked(found, "d1").collect()] == ["F2", "F1"]
    hits = lambda **kw: {r["finding_id"] for r in reports.search(full, names, **kw).collect()}
    assert hits(text="ALPHA") == {"F1", "F2"} and hits(text="backdated") == {"F2"} and hits(text="rule c") == {"F4"}
    assert hits(severity="HIGH", status="PENDING") == {"F3"} and len(hits(text="  ")) == 5
    order = lambda key, up: [r["finding_id"] for r in reports.sorted_by(full, key, up).collect()]
    assert order("severity", False) == ["F2", "F3", "F4", "F1", "F5"] and order("n_rows", True)[0] == "F4"
    assert order("rule_name", True)[0] == "F2" and order("status", True)[0] == "F2"
    groups = [tuple(r) for r in reports.by_dataset(full, names).collect()]
    assert groups == [("d1", "Alpha.csv", "HIGH", 2), ("d2", "Beta.csv", "HIGH", 1), ("d3", "d3", "MEDIUM", 2)]
    rules = [(r["rule_name"], r["finding_id"]) for r in reports.by_rule(full).collect()]
    assert rules == [("Rule A", "F3"), ("Rule A", "F2"), ("Rule C", "F4"), ("Rule B", "F5"), ("Rule B", "F1")]
    assert tuple(reports.dashboard(names, full).first()) == (2, 5, 2, 3)


def test_run_summary(found):
    assert reports.run_summary(found, 77).first()[0] == (
        "Analyzed 77 rows and raised 5 finding(s): 2 HIGH, 1 MEDIUM, 2 LOW. "
        "Most frequent rule triggers: Rule A (2), Rule B (2), Rule C (1)."
    )
    assert reports.run_summary(found.filter("false"), 12).first()[0] == (
        "No findings were raised across 12 rows for the enabled audit rules."
    )


def test_cascade(spark, found, log):
    tables = {"findings": found, "reviews": log, "datasets": found.select("dataset_id").distinct()}
    kept = store.cascade(tables, spark.createDataFrame([("d1",)], "dataset_id string"))
    assert {r["finding_id"] for r in kept["findings"].collect()} == {"F3", "F4", "F5"}
    assert {r["finding_id"] for r in kept["reviews"].collect()} == {"F3", "F4"}
    assert kept["datasets"].count() == 2
