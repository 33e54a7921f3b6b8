"""Turn rule hits into one findings table and one table of flagged rows.

Two tables, because a rule may flag most of a ledger: a nested array per finding
would put all of that into one cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.values import lookup, number_text
from tallyspark.operators import amounts, duplicates, row_rules, vendors
from tallyspark.operators.ledger import ROLE_SQL_TYPES, narrow, params_with

RULE_IDS = [r[0] for r in fv.RULES]
RULE_NAMES = {r[0]: r[1] for r in fv.RULES}
RULE_SEVERITY = {r[0]: r[2] for r in fv.RULES}
RULE_ORDER = {r[0]: i for i, r in enumerate(fv.RULES)}
RULE_NEEDS = {r[0]: r[4] for r in fv.RULES}

ROW_RULES = [
    "MISSING_REQUIRED_FIELD", "WEEKEND_POSTING", "PUBLIC_HOLIDAY_POSTING", "AFTER_HOURS_ENTRY",
    "BACKDATED_ENTRY", "ROUND_DOLLAR", "THRESHOLD_BREACH",
]

FINDING_SCHEMA = """
    rule_id string, rule_name string, severity string, finding_key string,
    seq struct<rule: int, text1: string, text2: string, number: double, at: timestamp_ntz,
               row_a: bigint, later: timestamp_ntz, row_b: bigint>,
    n_rows bigint, total_exposure double, duplicate_count bigint, p_value double,
    concentration_pct double, threshold_pct double, gap_pct double,
    supporting_metrics string, audit_explanation string,
    trace struct<fields_compared: array<string>, computation: string>
"""
ROW_SCHEMA = (
    "rule_id string, finding_key string, row_index bigint, "
    + ", ".join(f"{role} {kind}" for role, kind in ROLE_SQL_TYPES.items())
    + ", days int, missing_fields array<string>"
)
SCORE_INPUTS = {
    "total_exposure": "double", "duplicate_count": "bigint", "p_value": "double",
    "concentration_pct": "double", "threshold_pct": "double", "gap_pct": "double",
}


def enabled(rule_ids: list[str] | None) -> list[str]:
    """The rules to run: all when none are named, unknown names ignored."""
    return [r for r in rule_ids if r in RULE_IDS] if rule_ids else list(RULE_IDS)


def _key(rule_id: str, *parts: Column) -> Column:
    """The rule and its parts as JSON: parts cannot run into each other, and NULL differs from any text."""
    if not parts:
        return F.lit(rule_id)
    named = [p.cast("string").alias(f"k{i}") for i, p in enumerate(parts, 1)]
    return F.to_json(F.struct(F.lit(rule_id).alias("rule"), *named))


def _invoice_key() -> Column:
    return _key("DUPLICATE_INVOICE", F.col("invoice_no"), F.col("vendor"), F.col("amount"), F.col("date"))


def _split_key() -> Column:
    return _key("SPLIT_TRANSACTION", F.col("vendor"), F.col("date"))


def _pair_key() -> Column:
    return _key("DUPLICATE_PAYMENT", F.col("row_a"), F.col("row_b"))


def _text(rule_id: str, *args: Column) -> Column:
    return F.format_string(fv.EXPLANATION_FORMATS[rule_id], *[a.cast("string") for a in args])


def _finding(
    df: DataFrame, rule_id: str, *, n_rows: Column, metrics: dict[str, Column], text: Column,
    fields: list[str], computation: str, key: Column | None = None, seq: dict[str, Column] | None = None,
) -> DataFrame:
    """Project hits of one rule to the findings schema."""
    seq = seq or {}
    kinds = {"text1": "string", "text2": "string", "number": "double", "at": "timestamp_ntz",
             "row_a": "bigint", "later": "timestamp_ntz", "row_b": "bigint"}
    order = [F.lit(RULE_ORDER[rule_id]).alias("rule")] + [
        seq.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()
    ]
    inputs = [
        metrics.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SCORE_INPUTS.items()
    ]
    return df.select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(RULE_NAMES[rule_id]).alias("rule_name"),
        F.lit(RULE_SEVERITY[rule_id]).alias("severity"),
        (key if key is not None else F.lit(rule_id)).alias("finding_key"),
        F.struct(*order).alias("seq"),
        n_rows.cast("bigint").alias("n_rows"),
        *inputs,
        F.to_json(F.struct(*[c.alias(name) for name, c in metrics.items()])).alias("supporting_metrics"),
        text.alias("audit_explanation"),
        F.struct(
            F.array(*[F.lit(f) for f in fields]).cast("array<string>").alias("fields_compared"),
            F.lit(computation).alias("computation"),
        ).alias("trace"),
    )


def _duplicate_invoice(ledger: DataFrame, p: dict) -> DataFrame:
    c = F.col
    return _finding(
        duplicates.duplicate_invoices(ledger), "DUPLICATE_INVOICE",
        n_rows=c("duplicate_count"), key=_invoice_key(),
        metrics={n: c(n) for n in ("duplicate_count", "total_exposure", "amount")},
        seq={"text1": c("invoice_no"), "text2": c("vendor"), "number": c("amount"), "at": c("date")},
        text=_text("DUPLICATE_INVOICE", c("invoice_no"), c("duplicate_count"), c("vendor"),
                   number_text(c("amount")), c("date"), number_text(c("total_exposure"))),
        fields=["invoice_no", "vendor", "amount", "date"],
        computation="count of rows per invoice_no, vendor, amount, date above 1",
    )


def _duplicate_payment(pairs: DataFrame, p: dict) -> DataFrame:
    c = F.col
    return _finding(
        pairs, "DUPLICATE_PAYMENT",
        n_rows=F.lit(2), key=_pair_key(),
        metrics={n: c(n) for n in ("vendor", "amount", "days_apart")},
        seq={"text1": c("vendor"), "number": c("amount"), "at": c("date_a"), "row_a": c("row_a"),
             "later": c("date_b"), "row_b": c("row_b")},
        text=_text("DUPLICATE_PAYMENT", number_text(c("amount")), c("vendor"), c("days_apart")),
        fields=["vendor", "amount", "date", "invoice_no"],
        computation=f"equal vendor and amount at most {p['duplicate_payment_window_days']} days apart, "
                    "invoice numbers not equal",
    )


def _sequential_gap(ledger: DataFrame, p: dict) -> DataFrame:
    """Counts and samples are JSON numbers up to 38 digits; longer ones are given as text beside them."""
    c = F.col
    number = lambda text: text.try_cast("decimal(38,0)")
    listed = duplicates.missing_numbers(ledger).agg(
        F.sort_array(F.collect_list(F.struct(F.length("missing_number"), F.col("missing_number").alias("number")))).alias("all")
    ).select(F.col("all.number").alias("all"))
    sample = listed.select(F.struct(
        F.filter(F.transform("all", number), lambda x: x.isNotNull()).alias("numbers"),
        F.filter("all", lambda x: number(x).isNull()).alias("texts"),
    )).scalar()
    counts = ["expected_count", "missing_count"]
    return _finding(
        duplicates.sequential_gap(ledger), "SEQUENTIAL_GAP",
        n_rows=F.lit(0),
        metrics={
            "expected_count": number(c("expected_count")), "actual_count": c("actual_count"),
            "missing_count": number(c("missing_count")), "gap_pct": F.round("gap_pct", 2),
            "sample_missing": sample["numbers"],
            **{f"{n}_text": F.when(number(c(n)).isNull(), c(n)) for n in counts},
            "sample_missing_text": F.when(F.size(sample["texts"]) > 0, sample["texts"]),
        },
        text=_text("SEQUENTIAL_GAP", c("first_number"), c("last_number"), c("expected_count"), c("actual_count"),
                   c("missing_count"), F.format_string("%.1f", c("gap_pct"))),
        fields=["invoice_no"],
        computation="distinct invoice numbers against the span from the smallest to the largest",
    )


def _row_findings(ledger: DataFrame, p: dict, rule_ids: list[str]) -> DataFrame | None:
    """Findings of all row-local rules from one aggregate over the ledger."""
    checks = {r: c for r, c in row_rules.row_checks(ledger, p).items() if r in rule_ids}
    if not checks:
        return None
    counts = row_rules.all_counts(ledger, checks)
    n = F.col("n_rows")
    fields = row_rules.checked_fields(ledger)
    hours = f"{p['business_hours_start']:02d}:00-{p['business_hours_end']:02d}:00"
    lit = lambda key: F.lit(p[key])
    # rule: metrics, arguments of the explanation, compared fields, computation
    parts = {
        "MISSING_REQUIRED_FIELD": (
            {"checked_fields": F.array(*[F.lit(f) for f in fields]), "affected_row_count": n},
            [n, F.lit(str(fields))], fields, "any checked field is null",
        ),
        "WEEKEND_POSTING": ({"weekend_entry_count": n}, [n], ["date"], "weekday of date is Saturday or Sunday"),
        "PUBLIC_HOLIDAY_POSTING": (
            {"holiday_entry_count": n}, [n], ["date"], "month and day of date in the holiday list",
        ),
        "AFTER_HOURS_ENTRY": (
            {"after_hours_count": n, "business_hours": F.lit(hours)}, [n, F.lit(hours)], ["timestamp"],
            f"hour of timestamp outside {hours}",
        ),
        "BACKDATED_ENTRY": (
            {"backdated_count": n, "threshold_days": lit("backdated_threshold_days")},
            [n, lit("backdated_threshold_days")], ["date", "entry_date"],
            f"whole days from date to entry_date above {p['backdated_threshold_days']}",
        ),
        "ROUND_DOLLAR": (
            {"round_dollar_count": n, "min_amount": lit("round_dollar_min_amount")},
            [n, lit("round_dollar_min_amount")], ["amount"],
            f"whole amount with absolute value above {p['round_dollar_min_amount']}",
        ),
        "THRESHOLD_BREACH": (
            {"breach_count": n, "threshold": lit("materiality_threshold"), "max_amount": F.col("max_amount")},
            [n, lit("materiality_threshold")], ["amount"],
            f"absolute amount above {p['materiality_threshold']}",
        ),
    }

    def pick(column_of) -> Column:
        table = {r: column_of(*parts[r]) for r in checks}
        first, *rest = table.items()
        start = F.when(F.col("rule_id") == first[0], first[1])
        return reduce(lambda acc, kv: acc.when(F.col("rule_id") == kv[0], kv[1]), rest, start)

    null = F.lit(None)
    return counts.select(
        "rule_id",
        lookup(RULE_NAMES, F.col("rule_id"), null).alias("rule_name"),
        lookup(RULE_SEVERITY, F.col("rule_id"), null).alias("severity"),
        F.col("rule_id").alias("finding_key"),
        F.struct(
            lookup(RULE_ORDER, F.col("rule_id"), null).alias("rule"),
            null.cast("string").alias("text1"), null.cast("string").alias("text2"),
            null.cast("double").alias("number"), null.cast("timestamp_ntz").alias("at"),
            null.cast("bigint").alias("row_a"), null.cast("timestamp_ntz").alias("later"),
            null.cast("bigint").alias("row_b"),
        ).alias("seq"),
        "n_rows",
        *[null.cast(kind).alias(name) for name, kind in SCORE_INPUTS.items()],
        pick(lambda m, a, f, c: F.to_json(F.struct(*[v.alias(k) for k, v in m.items()]))).alias("supporting_metrics"),
        F.coalesce(*[
            F.when(F.col("rule_id") == r, _text(r, *parts[r][1])) for r in checks
        ]).alias("audit_explanation"),
        F.struct(
            pick(lambda m, a, f, c: F.array(*[F.lit(x) for x in f])).alias("fields_compared"),
            pick(lambda m, a, f, c: F.lit(c)).alias("computation"),
        ).alias("trace"),
    )


def _split_transaction(ledger: DataFrame, p: dict) -> DataFrame:
    c = F.col
    return _finding(
        amounts.split_transactions(ledger, p), "SPLIT_TRANSACTION",
        n_rows=c("transaction_count"), key=_split_key(),
        metrics={
            "vendor": c("vendor"), "date": c("date").cast("string"), "transaction_count": c("transaction_count"),
            "total_amount": c("total_amount"), "threshold": F.lit(p["materiality_threshold"]),
        },
        seq={"text1": c("vendor"), "at": c("date")},
        text=_text("SPLIT_TRANSACTION", c("vendor"), c("transaction_count"), c("date"),
                   number_text(c("total_amount")), F.lit(p["materiality_threshold"])),
        fields=["vendor", "amount", "date"],
        computation="whole total per vendor and date above the materiality threshold",
    )


def _benford(ledger: DataFrame, p: dict) -> DataFrame:
    c = F.col
    return _finding(
        amounts.benford(ledger, p), "BENFORDS_LAW",
        n_rows=F.least(F.lit(fv.BENFORD_EVIDENCE_ROWS), c("worst_observed")),
        metrics={
            "chi_squared": c("chi_squared"), "p_value": c("p_value"), "sample_size": c("sample_size"),
            "observed_pct_by_first_digit": c("observed_pct"), "expected_pct_by_first_digit": c("expected_pct"),
        },
        text=_text("BENFORDS_LAW", c("sample_size"), F.format_string("%.2f", c("chi_squared")),
                   F.format_string("%.4f", c("p_value")), F.lit(p["benford_p_value"]), c("worst_digit"),
                   c("worst_observed_pct"), c("worst_expected_pct")),
        fields=["amount"],
        computation="chi-squared test of leading digits with 8 degrees of freedom",
    )


def _dormant_vendor(ledger: DataFrame, p: dict) -> DataFrame:
    n = F.col("n")
    hits = vendors.dormant_vendor_rows(ledger, p).agg(F.count(F.lit(1)).alias("n")).filter(n > 0)
    return _finding(
        hits, "DORMANT_VENDOR", n_rows=n,
        metrics={"reactivation_count": n, "dormant_days_threshold": F.lit(p["dormant_vendor_days"])},
        text=_text("DORMANT_VENDOR", n, F.lit(p["dormant_vendor_days"])),
        fields=["vendor", "date"],
        computation=f"whole days since the vendor's previous posting above {p['dormant_vendor_days']}",
    )


def _new_vendor(ledger: DataFrame, p: dict) -> DataFrame:
    n = F.col("n")
    hits = vendors.new_vendor_rows(ledger, p).agg(F.count(F.lit(1)).alias("n")).filter(n > 0)
    return _finding(
        hits, "NEW_VENDOR_HIGH_VALUE", n_rows=n,
        metrics={
            "flagged_count": n, "window_days": F.lit(p["new_vendor_window_days"]),
            "high_value_threshold": F.lit(p["new_vendor_high_value"]),
        },
        text=_text("NEW_VENDOR_HIGH_VALUE", n, F.lit(p["new_vendor_high_value"]), F.lit(p["new_vendor_window_days"])),
        fields=["vendor", "date", "amount"],
        computation=f"at most {p['new_vendor_window_days']} whole days after the vendor's first posting and "
                    f"absolute amount above {p['new_vendor_high_value']}",
    )


def _concentration(ledger: DataFrame, p: dict) -> DataFrame:
    c = F.col
    return _finding(
        vendors.vendor_concentration(ledger, p), "SINGLE_VENDOR_CONCENTRATION",
        n_rows=F.lit(0), key=_key("SINGLE_VENDOR_CONCENTRATION", c("vendor")),
        metrics={
            "vendor": c("vendor"), "vendor_spend": c("vendor_spend"), "total_spend": c("total_spend"),
            "concentration_pct": F.round("concentration_pct", 2), "threshold_pct": F.lit(p["vendor_concentration_pct"]),
        },
        seq={"number": -c("concentration_pct"), "text1": c("vendor")},
        text=_text("SINGLE_VENDOR_CONCENTRATION", c("vendor"), F.format_string("%.1f", c("concentration_pct")),
                   F.format_number("vendor_spend", 2), F.format_number("total_spend", 2),
                   F.lit(p["vendor_concentration_pct"])),
        fields=["vendor", "amount"],
        computation="absolute spend of the vendor as a share of all absolute spend",
    )


GROUP_RULES = {
    "DUPLICATE_INVOICE": _duplicate_invoice,
    "SEQUENTIAL_GAP": _sequential_gap,
    "SPLIT_TRANSACTION": _split_transaction,
    "BENFORDS_LAW": _benford,
    "DORMANT_VENDOR": _dormant_vendor,
    "NEW_VENDOR_HIGH_VALUE": _new_vendor,
    "SINGLE_VENDOR_CONCENTRATION": _concentration,
}


def _runnable(ledger: DataFrame, rule_ids: list[str] | None) -> list[str]:
    return [r for r in enabled(rule_ids) if set(RULE_NEEDS[r]) <= set(ledger.columns)]


def _stacked(parts: list[DataFrame], df: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    while len(parts) > 1:  # pairwise, so each part is analyzed in few unions; all parts have the schema's column order
        parts = [reduce(DataFrame.union, parts[i:i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def payment_pairs(
    df: DataFrame, rule_ids: list[str] | None = None, params: dict | None = None, stage=None
) -> duplicates.PaymentCells | None:
    """Cell pairs for `findings` and `finding_rows`, so that a run finds them once; None if the rule does not run."""
    ledger = narrow(df)
    if "DUPLICATE_PAYMENT" not in _runnable(ledger, rule_ids):
        return None
    return duplicates.payment_cells(ledger, params_with(params), stage)


def findings(
    df: DataFrame, rule_ids: list[str] | None = None, params: dict | None = None,
    pairs: duplicates.PaymentCells | None = None,
) -> DataFrame:
    """All findings of the enabled rules; order by `seq` for reporting order."""
    ledger, p = narrow(df), params_with(params)
    runnable = _runnable(ledger, rule_ids)
    parts = [GROUP_RULES[r](ledger, p) for r in runnable if r in GROUP_RULES]
    if "DUPLICATE_PAYMENT" in runnable:
        found = duplicates.payment_cells(ledger, p) if pairs is None else pairs
        parts.append(_duplicate_payment(duplicates.unfolded(found), p))
    if (row_part := _row_findings(ledger, p, runnable)) is not None:
        parts.append(row_part)
    return _stacked(parts, df, FINDING_SCHEMA)


def finding_rows(
    df: DataFrame, rule_ids: list[str] | None = None, params: dict | None = None,
    pairs: duplicates.PaymentCells | None = None,
) -> DataFrame:
    """Flagged rows of the enabled rules, keyed by `finding_key`."""
    ledger, p = narrow(df), params_with(params)
    runnable = _runnable(ledger, rule_ids)
    snapshot = ["row_index", *ROLE_SQL_TYPES]
    none = F.lit(None)

    def shaped(rows: DataFrame, rule_id: str, key: Column) -> DataFrame:
        days = F.col("days") if "days" in rows.columns else none
        return rows.select(
            F.lit(rule_id).alias("rule_id"), key.alias("finding_key"), *snapshot,
            days.cast("int").alias("days"), none.cast("array<string>").alias("missing_fields"),
        )

    parts = []
    if "DUPLICATE_INVOICE" in runnable:
        parts.append(shaped(duplicates.duplicate_invoice_rows(ledger), "DUPLICATE_INVOICE", _invoice_key()))
    if "DUPLICATE_PAYMENT" in runnable:
        pairs = duplicates.payment_cells(ledger, p) if pairs is None else pairs
        parts.append(shaped(duplicates.duplicate_payment_rows(pairs), "DUPLICATE_PAYMENT", _pair_key()))
    checks = {r: c for r, c in row_rules.row_checks(ledger, p).items() if r in runnable}
    if checks:
        parts.append(
            row_rules.all_rows(ledger, checks)
            .withColumn("finding_key", F.col("rule_id"))
            .select("rule_id", "finding_key", *snapshot, "days", "missing_fields")
        )
    if "SPLIT_TRANSACTION" in runnable:
        parts.append(shaped(amounts.split_transaction_rows(ledger, p), "SPLIT_TRANSACTION", _split_key()))
    for rule_id, rows_of in (
        ("BENFORDS_LAW", amounts.benford_evidence),
        ("DORMANT_VENDOR", vendors.dormant_vendor_rows),
        ("NEW_VENDOR_HIGH_VALUE", vendors.new_vendor_rows),
    ):
        if rule_id in runnable:
            parts.append(shaped(rows_of(ledger, p), rule_id, F.lit(rule_id)))
    return _stacked(parts, df, ROW_SCHEMA)


def row_snapshot_json(rows: DataFrame) -> DataFrame:
    """Add `snapshot`: the flagged row as JSON, nulls left out, ISO timestamps, the day count under its rule's name."""
    iso = lambda name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
    day_names = {
        "days_backdated": "BACKDATED_ENTRY", "days_dormant": "DORMANT_VENDOR",
        "days_since_first_transaction": "NEW_VENDOR_HIGH_VALUE",
    }
    return rows.withColumn("snapshot", F.to_json(F.struct(
        "row_index", "invoice_no", "vendor", "amount", iso("date"), iso("entry_date"), iso("timestamp"),
        *[F.when(F.col("rule_id") == rule, F.col("days")).alias(name) for name, rule in day_names.items()],
        "missing_fields",
    )))
