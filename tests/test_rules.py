import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.operators import duplicates, findings as fnd, scoring
from tallyspark.operators.ledger import narrow

RULE_IDS = [r[0] for r in fv.RULES]


def found(df, rule_id, **params):
    rows = fnd.findings(df, [rule_id], params).orderBy("seq").collect()
    return [r.asDict() | {"metrics": json.loads(r["supporting_metrics"])} for r in rows]


def flagged(df, rule_id, **params):
    return fnd.finding_rows(df, [rule_id], params).orderBy("row_index").collect()


def test_fifteen_unique_rules():
    assert len(RULE_IDS) == 15 and len(set(RULE_IDS)) == 15


def test_clean_ledger_has_no_findings(clean_ledger):
    assert fnd.findings(clean_ledger).collect() == []
    assert fnd.finding_rows(clean_ledger).collect() == []


def test_unmapped_ledger_has_no_findings(make):
    df = make(unrelated=[1, 2, 3])
    assert fnd.findings(df).collect() == [] and fnd.finding_rows(df).collect() == []


def test_empty_ledger_has_no_findings(make):
    df = make(invoice_no=[], vendor=[], amount=[], date=[], entry_date=[], timestamp=[])
    assert fnd.findings(df).collect() == [] and fnd.finding_rows(df).collect() == []


def test_all_null_roles_only_report_missing_fields(make):
    df = make(invoice_no=[None], vendor=[None], amount=[None], date=[None], entry_date=[None], timestamp=[None])
    assert [r["rule_id"] for r in fnd.findings(df).collect()] == ["MISSING_REQUIRED_FIELD"]


def test_duplicate_invoice(make):
    df = make(invoice_no=["F77/a", "F77/a", "F78", "F77/a"], vendor=["Harbour Supply"] * 4, amount=[412.5, 412.5, 90.25, 412.5],
              date=["2024-03-05", "2024-03-05", "2024-03-06", "2024-03-05"])
    (f,) = found(df, "DUPLICATE_INVOICE")
    assert f["n_rows"] == 3 and f["metrics"] == {"duplicate_count": 3, "total_exposure": 825.0, "amount": 412.5}
    assert f["audit_explanation"].startswith(
        "Invoice F77/a was posted 3 times to vendor Harbour Supply for the same amount (412.5) on 2024-03-05 00:00:00."
    )
    rows = flagged(df, "DUPLICATE_INVOICE")
    assert [r["row_index"] for r in rows] == [0, 1, 3] and {r["finding_key"] for r in rows} == {f["finding_key"]}


def test_keys_do_not_run_into_each_other(make):
    """A separator inside a value still gives two findings."""
    df = make(invoice_no=["A|B", "A|B", "A", "A"], vendor=["C", "C", "B|C", "B|C"], amount=[5, 5, 5, 5], date=["2024-03-05"] * 4)
    both = found(df, "DUPLICATE_INVOICE")
    assert len({f["finding_key"] for f in both}) == len(both) == 2
    keys = flagged(df, "DUPLICATE_INVOICE")
    assert {k["finding_key"] for k in keys} == {f["finding_key"] for f in both} and len(keys) == 4


def test_duplicate_payment(make):
    two = dict(vendor=["Mill & Sons", "Mill & Sons"], amount=[77.7, 77.7])
    df = make(invoice_no=["x1", "x2"], date=["2024-02-27", "2024-03-02"], **two)
    (f,) = found(df, "DUPLICATE_PAYMENT")
    assert f["metrics"] == {"vendor": "Mill & Sons", "amount": 77.7, "days_apart": 4}
    assert len(flagged(df, "DUPLICATE_PAYMENT")) == 2
    assert found(make(invoice_no=["x1", "x1"], date=["2024-02-27", "2024-03-02"], **two), "DUPLICATE_PAYMENT") == []
    assert found(make(invoice_no=["x1", "x2"], date=["2024-02-27", "2024-03-06"], **two), "DUPLICATE_PAYMENT") == []
    # missing invoices are not equal, and whole days count
    assert len(found(make(invoice_no=[None, None], date=["2024-02-27", "2024-02-27"], **two), "DUPLICATE_PAYMENT")) == 1
    assert len(found(make(date=["2024-02-27 12:00", "2024-03-06 11:59"], **two), "DUPLICATE_PAYMENT")) == 1


def test_a_hot_cell_is_unfolded_evenly(spark):
    """5,000 equal payments without invoice: no partition of the 12,497,500 pairs holds more than twice the mean."""
    n = 5_000
    rows = spark.range(n).selectExpr(
        "id AS row_index", "CAST(NULL AS STRING) AS invoice_no", "'one' AS vendor", "10.0D AS amount", "TIMESTAMP_NTZ'2024-03-05' AS date"
    )
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = duplicates.duplicate_payments(narrow(rows)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    counts = [r["count"] for r in sizes]
    assert sum(counts) == n * (n - 1) // 2 and len(counts) >= 8 and max(counts) <= 2 * sum(counts) / len(counts)


@pytest.mark.parametrize("window,tile,slice_rows", [(7, 4096, 1_000_000), (0, 3, 2), (3, 3, 2)])
def test_duplicate_payment_against_brute_force(make, monkeypatch, window, tile, slice_rows):
    monkeypatch.setattr(duplicates, "TILE", tile)
    monkeypatch.setattr(duplicates.salted_join, "__defaults__", (slice_rows,))
    monkeypatch.setattr(duplicates, "UNFOLD", 128 if slice_rows > 2 else 2)
    rng = random.Random(7)
    n = 160
    vendor = [rng.choice(["hot", "hot", "a", None]) for _ in range(n)]
    amount = [rng.choice([10.0, 10.0, 20.0, None]) for _ in range(n)]
    invoice = [rng.choice(["I1", "I1", "I2", "I3", None]) for _ in range(n)]
    date = [f"2024-01-{rng.randint(1, 20):02d} {rng.choice([0, 6, 23]):02d}:00" for _ in range(n)]
    df = make(invoice_no=invoice, vendor=vendor, amount=amount, date=date)

    from conftest import at

    expected = set()
    for i, j in combinations(range(n), 2):
        if None in (vendor[i], vendor[j], amount[i], amount[j]):
            continue
        if vendor[i] != vendor[j] or amount[i] != amount[j]:
            continue
        a, b = sorted((i, j), key=lambda k: (at(date[k]), k))
        days = (at(date[b]) - at(date[a])).days
        if days > window or (invoice[i] is not None and invoice[i] == invoice[j]):
            continue
        expected.add((a, b, days))
    pairs = duplicates.duplicate_payments(narrow(df), {"duplicate_payment_window_days": window}).collect()
    got = [(r["row_a"], r["row_b"], r["days_apart"]) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == expected


def test_sequential_gap(make):
    numbers = [n for n in range(540, 565) if n not in (544, 551, 552, 553)]
    (f,) = found(make(invoice_no=[f"No {n}" for n in numbers]), "SEQUENTIAL_GAP")
    assert f["metrics"] == {
        "expected_count": 25, "actual_count": 21, "missing_count": 4, "gap_pct": 16.0, "sample_missing": [544, 551, 552, 553],
    }
    assert "spans 540-564 (25 expected), but only 21 were found (4 missing, 16.0% gap)" in f["audit_explanation"]


def test_sequential_gap_edges(make):
    whole = [f"R{n:05d}" for n in range(80, 96)] + [None, "", "without digits"]
    assert found(make(invoice_no=whole), "SEQUENTIAL_GAP") == []
    huge = [str(10**30 + 3 * i) for i in range(12)]
    (f,) = found(make(invoice_no=huge), "SEQUENTIAL_GAP")
    assert f["metrics"]["sample_missing"][:3] == [10**30 + 1, 10**30 + 2, 10**30 + 4]
    rng = random.Random(3)
    numbers = sorted(rng.sample(range(500), 200))
    (f,) = found(make(invoice_no=[str(n) for n in numbers]), "SEQUENTIAL_GAP")
    missing = [n for n in range(numbers[0], numbers[-1]) if n not in set(numbers)]
    assert f["metrics"]["sample_missing"] == missing[:25]


@pytest.mark.parametrize("numbers", [
    [10**38 - 1 - 2 * i for i in range(12)], [10**45 + 7 * i for i in range(12)], [0, *range(10**37 - 5, 10**37 + 15, 2)],
    [*range(3, 30, 2), 10**60],
])
def test_sequential_gap_of_long_numbers(make, numbers):
    numbers = sorted(numbers)
    (f,) = found(make(invoice_no=[f"{n:050d}" if n % 2 else str(n) for n in numbers]), "SEQUENTIAL_GAP")
    m = f["metrics"]
    expected, value = numbers[-1] - numbers[0] + 1, lambda n: int(m.get(n, m.get(f"{n}_text")))
    assert (value("expected_count"), value("missing_count")) == (expected, expected - len(numbers))
    first, n = [], numbers[0]
    while len(first) < 25 and n < numbers[-1]:
        first += [n] * (n not in numbers)
        n += 1
    assert m.get("sample_missing", []) + [int(x) for x in m.get("sample_missing_text", [])] == first
    assert f"spans {numbers[0]}-{numbers[-1]} ({expected} expected)" in f["audit_explanation"]


def test_amounts_that_no_decimal_holds(make):
    """Huge and tiny amounts neither stop a rule nor change the totals of other vendors."""
    df = make(
        vendor=["Big", "Big", "Fine", "Fine", "Odd", "Odd"], amount=[1e23, 1e35, 30000.12345678, 30000.87654322, 1e300, 0.5],
        date=["2024-03-05"] * 6, invoice_no=list("abcdef"),
    )
    got = {f["metrics"]["vendor"]: f["metrics"]["total_amount"] for f in found(df, "SPLIT_TRANSACTION")}
    assert got == {"Big": 1e35 + 1e23, "Fine": 60001.0, "Odd": 1e300}
    (f,) = found(df, "SINGLE_VENDOR_CONCENTRATION")
    assert f["metrics"]["vendor"] == "Odd" and f["metrics"]["concentration_pct"] == 100.0
    assert fnd.findings(df).count() > 3 and fnd.finding_rows(df).count() > 3


def test_missing_required_field(make):
    df = make(invoice_no=["q9", None], vendor=["Kiln", "Loom"], amount=[81.5, 64], date=["2024-05-07", "2024-05-08"])
    (f,) = found(df, "MISSING_REQUIRED_FIELD")
    assert f["metrics"] == {"checked_fields": ["vendor", "amount", "date", "invoice_no"], "affected_row_count": 1}
    (row,) = flagged(df, "MISSING_REQUIRED_FIELD")
    assert row["missing_fields"] == ["invoice_no"] and row["row_index"] == 1


def test_calendar_rules(make):
    (f,) = found(make(date=["2024-06-01", "2024-06-02", "2024-06-03"]), "WEEKEND_POSTING")
    assert f["metrics"] == {"weekend_entry_count": 2}
    (f,) = found(make(date=["2024-07-04", "2024-07-05"]), "PUBLIC_HOLIDAY_POSTING")
    assert f["metrics"] == {"holiday_entry_count": 1}
    assert found(make(date=["2024-12-25"]), "PUBLIC_HOLIDAY_POSTING", public_holidays_mmdd=["02-02"]) == []
    (f,) = found(make(timestamp=["2024-05-07 06:59", "2024-05-07 07:00", "2024-05-07 18:59"]), "AFTER_HOURS_ENTRY")
    assert f["metrics"] == {"after_hours_count": 1, "business_hours": "07:00-19:00"}


def test_backdated(make):
    df = make(date=["2024-04-10", "2024-04-10"], entry_date=["2024-05-10", "2024-06-01"])
    (f,) = found(df, "BACKDATED_ENTRY")
    assert f["metrics"] == {"backdated_count": 1, "threshold_days": 30}
    assert [r["days"] for r in flagged(df, "BACKDATED_ENTRY")] == [52]
    almost = make(date=["2024-01-01 12:00"], entry_date=["2024-02-01 11:00"])  # 30 whole days
    assert found(almost, "BACKDATED_ENTRY") == []


def test_amount_rules(make):
    (f,) = found(make(amount=[2750, 1000, 3020.5]), "ROUND_DOLLAR")
    assert f["metrics"] == {"round_dollar_count": 1, "min_amount": 1000}
    (f,) = found(make(amount=[50001, -90000, 50000]), "THRESHOLD_BREACH")
    assert f["metrics"] == {"breach_count": 2, "threshold": 50000, "max_amount": 90000.0}
    (f,) = found(make(amount=[50001]), "THRESHOLD_BREACH", materiality_threshold=0)
    assert f["metrics"]["threshold"] == 50000


def test_split_transaction(make):
    df = make(vendor=["Kiln"] * 3, amount=[17000.1, 17000.2, 26999.7], date=["2024-05-07"] * 3)
    (f,) = found(df, "SPLIT_TRANSACTION")
    assert f["metrics"]["total_amount"] == 61000.0 and f["metrics"]["date"] == "2024-05-07 00:00:00"
    assert len(flagged(df, "SPLIT_TRANSACTION")) == 3
    assert found(make(vendor=["Kiln"] * 2, amount=[60000.5, 1.25], date=["2024-05-07"] * 2), "SPLIT_TRANSACTION") == []


def test_benford(make):
    rng = random.Random(42)
    df = make(amount=[rng.uniform(200, 800) for _ in range(260)])
    (f,) = found(df, "BENFORDS_LAW")
    assert f["metrics"]["p_value"] < 0.05 and f["metrics"]["sample_size"] == 260
    assert len(f["metrics"]["observed_pct_by_first_digit"]) == 9
    assert len(flagged(df, "BENFORDS_LAW")) == f["n_rows"] == 25
    assert found(make(amount=[314, 271]), "BENFORDS_LAW") == []


def test_benford_p_value():
    import math

    x = 15.507
    h = x / 2
    assert math.isclose(math.exp(-h) * (1 + h + h * h / 2 + h**3 / 6), 0.05, abs_tol=1e-4)


def test_dormant_vendor(make):
    df = make(vendor=["Kiln"] * 3, date=["2022-11-15", "2023-06-20", "2023-06-20"])
    (f,) = found(df, "DORMANT_VENDOR")
    assert f["metrics"] == {"reactivation_count": 1, "dormant_days_threshold": 180}
    (row,) = flagged(df, "DORMANT_VENDOR")
    assert (row["row_index"], row["days"]) == (1, 217)


@pytest.mark.parametrize("limit", [0, 1, 45])
def test_dormant_vendor_against_brute_force(make, limit):
    from conftest import at

    rng = random.Random(limit)
    n = 120
    vendor = [rng.choice("abc") for _ in range(n)]
    date = [f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00" for _ in range(n)]
    expected = set()
    for v in "abc":
        order = sorted((at(date[i]), i) for i in range(n) if vendor[i] == v)
        for (before, _), (now, i) in zip(order, order[1:]):
            if (now - before).days > limit:
                expected.add((i, (now - before).days))
    rows = flagged(make(vendor=vendor, date=date), "DORMANT_VENDOR", dormant_vendor_days=limit)
    assert {(r["row_index"], r["days"]) for r in rows} == expected


def test_new_vendor(make):
    df = make(vendor=["Fresh", "Fresh"], date=["2024-04-02", "2024-05-03"], amount=[10000.5, 44000])
    (f,) = found(df, "NEW_VENDOR_HIGH_VALUE")
    assert f["metrics"] == {"flagged_count": 1, "window_days": 30, "high_value_threshold": 10000}
    # the first date ignores rows without an amount
    df = make(vendor=["X", "X"], date=["2023-04-01", "2024-04-01"], amount=[None, 12000])
    assert [r["days"] for r in flagged(df, "NEW_VENDOR_HIGH_VALUE")] == [0]


def test_vendor_concentration(make):
    df = make(vendor=["Tower"] * 2 + ["Shed"] * 4, amount=[9000] * 2 + [250] * 4)
    (f,) = found(df, "SINGLE_VENDOR_CONCENTRATION")
    assert f["metrics"]["vendor"] == "Tower" and f["metrics"]["concentration_pct"] == 94.74
    assert "94.7% of total spend (18,000.00 of 19,000.00)" in f["audit_explanation"]
    assert found(make(vendor=["Z"], amount=[0]), "SINGLE_VENDOR_CONCENTRATION") == []


def test_numeric_invoice_numbers(spark):
    df = spark.range(20).selectExpr("id AS row_index", "CAST(10000000 + id * 2 AS DOUBLE) AS invoice_no")
    (f,) = found(df, "SEQUENTIAL_GAP")
    assert f["metrics"]["sample_missing"][0] == 10000001


def test_enabled_rules(make):
    df = make(amount=[60000.0], date=["2024-01-06"])
    assert {r["rule_id"] for r in fnd.findings(df, ["ROUND_DOLLAR", "NO_SUCH_RULE"]).collect()} == {"ROUND_DOLLAR"}
    every = {r["rule_id"] for r in fnd.findings(df, []).collect()}
    assert every == {"ROUND_DOLLAR", "THRESHOLD_BREACH", "WEEKEND_POSTING"}


def test_snapshot_leaves_nulls_out(make):
    df = make(vendor=["Kiln", "Kiln"], date=["2022-11-15", "2023-06-20 10:30"])
    (row,) = fnd.row_snapshot_json(fnd.finding_rows(df, ["DORMANT_VENDOR"])).collect()
    assert json.loads(row["snapshot"]) == {
        "row_index": 1, "vendor": "Kiln", "date": "2023-06-20T10:30:00", "days_dormant": 217,
    }


def test_schemas_are_stable(clean_ledger, spark):
    empty = spark.createDataFrame([], fnd.FINDING_SCHEMA)
    full = fnd.findings(clean_ledger)
    assert [(f.name, f.dataType) for f in full.schema] == [(f.name, f.dataType) for f in empty.schema]
    rows = fnd.finding_rows(clean_ledger)
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], fnd.ROW_SCHEMA).schema]
    assert scoring.score(full).columns[-2:] == ["risk_score", "risk_justification"]
