"""Rules that look at one row at a time.

Each is a predicate, so all of them share one scan: counts come from a single
aggregate and flagged rows from a single projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.values import exceeds, has_columns, whole_days
from tallyspark.operators.ledger import params_with, snapshot_columns


@dataclass
class RowCheck:
    flagged: Column
    days: Column | None = None
    missing_fields: Column | None = None


def checked_fields(ledger: DataFrame) -> list[str]:
    return [f for f in fv.CHECKED_FIELDS if f in ledger.columns]


def row_checks(ledger: DataFrame, params: dict | None = None) -> dict[str, RowCheck]:
    """The row-local rules this ledger has columns for."""
    p = params_with(params)
    amount, date = F.col("amount"), F.col("date")
    checks: dict[str, RowCheck] = {}

    if fields := checked_fields(ledger):
        missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
        checks["MISSING_REQUIRED_FIELD"] = RowCheck(F.size(missing) > 0, missing_fields=missing)
    if has_columns(ledger, ["date"]):
        checks["WEEKEND_POSTING"] = RowCheck(F.weekday(date) >= 5)
        checks["PUBLIC_HOLIDAY_POSTING"] = RowCheck(
            F.date_format(date, "MM-dd").isin(list(p["public_holidays_mmdd"]))
        )
    if has_columns(ledger, ["timestamp"]):
        hour = F.hour("timestamp")
        checks["AFTER_HOURS_ENTRY"] = RowCheck(
            (hour < p["business_hours_start"]) | (hour >= p["business_hours_end"])
        )
    if has_columns(ledger, ["date", "entry_date"]):
        days = whole_days(date, F.col("entry_date"))
        checks["BACKDATED_ENTRY"] = RowCheck(days > p["backdated_threshold_days"], days=days)
    if has_columns(ledger, ["amount"]):
        checks["ROUND_DOLLAR"] = RowCheck(exceeds(amount, p["round_dollar_min_amount"]) & (amount % 1 == 0))
        checks["THRESHOLD_BREACH"] = RowCheck(exceeds(amount, p["materiality_threshold"]))
    return checks


def rows_of(ledger: DataFrame, rule_id: str, params: dict | None = None) -> DataFrame:
    """Flagged rows of one rule; the predicate reaches the scan."""
    check = row_checks(ledger, params).get(rule_id)
    kept = ledger.filter(check.flagged) if check else ledger.filter(F.lit(False))
    return kept.select(*snapshot_columns(ledger), *_extras(check))


def _extras(check: RowCheck | None) -> list[Column]:
    days = check.days if check and check.days is not None else F.lit(None)
    missing = check.missing_fields if check and check.missing_fields is not None else F.lit(None)
    return [days.cast("int").alias("days"), missing.cast("array<string>").alias("missing_fields")]


def all_rows(ledger: DataFrame, checks: dict[str, RowCheck]) -> DataFrame:
    """(rule_id, row snapshot, extras) for every check in one pass."""
    hits = [
        F.when(check.flagged, F.struct(F.lit(rule_id).alias("rule_id"), *_extras(check)))
        for rule_id, check in checks.items()
    ]
    return (
        ledger.select(*snapshot_columns(ledger), F.explode(F.array_compact(F.array(*hits))).alias("_hit"))
        .select(F.col("_hit.rule_id"), *[c for c in _snapshot_names()], "_hit.days", "_hit.missing_fields")
    )


def _snapshot_names() -> list[str]:
    return ["row_index", "invoice_no", "vendor", "amount", "date", "entry_date", "timestamp"]


def all_counts(ledger: DataFrame, checks: dict[str, RowCheck]) -> DataFrame:
    """(rule_id, n_rows, max_amount) for every check with hits, from one aggregate."""
    top = F.max(F.when(checks["THRESHOLD_BREACH"].flagged, F.abs("amount"))) if "THRESHOLD_BREACH" in checks else (
        F.lit(None).cast("double")
    )
    totals = ledger.agg(
        F.array(*[
            F.struct(F.lit(rule_id).alias("rule_id"), F.count_if(check.flagged).alias("n_rows"))
            for rule_id, check in checks.items()
        ]).alias("_counts"),
        top.alias("max_amount"),
    )
    return (
        totals.select(F.explode("_counts").alias("_c"), "max_amount")
        .select("_c.rule_id", "_c.n_rows", "max_amount")
        .filter(F.col("n_rows") > 0)
    )
