"""Vendor behaviour: dormancy, new vendors, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyspark.functions.skew import salted_join
from tallyspark.functions.values import day_number, either_part, exact_parts, exceeds, merged_parts, whole_days
from tallyspark.operators.ledger import params_with, snapshot_columns, with_values


def dormant_vendor_rows(ledger: DataFrame, params: dict | None = None, before: DataFrame | None = None) -> DataFrame:
    """Rows that follow more than n whole days without a posting of that vendor.

    Dates are folded into spans of n days per vendor (vendor, span). Inside a span no gap can
    exceed n days, so only the first row of a span can be a reactivation, and its
    predecessor is the last date of the span before. The window therefore sees one
    row per vendor and span, however many rows a vendor has, and hits are joined back by row.
    `before` (vendor, last_date) stands for earlier rows that are not in `ledger`.
    """
    limit = int(params_with(params)["dormant_vendor_days"])
    dated = with_values(ledger, ["vendor", "date"])
    hits = _reactivations(dated, limit, before)
    return hits.join(dated.select(*snapshot_columns(ledger)), "row_index").select(
        *[c for c in snapshot_columns(dated)], "days"
    )


def _reactivations(dated: DataFrame, limit: int, before: DataFrame | None) -> DataFrame:
    """(row_index, days): the rows with which a vendor comes back. Two dates a span, in a hash aggregate."""
    span = lambda date: F.floor(day_number(F.col(date)) / max(1, limit)).alias("_span")
    spans = dated.groupBy("vendor", span("date")).agg(F.min(F.struct("date", "row_index")).alias("_first"), F.max("date").alias("_last"))
    if before is not None:
        known = before.filter(F.col("last_date").isNotNull()).select("vendor", span("last_date"), F.col("last_date").alias("_last"))
        spans = spans.unionByName(known, allowMissingColumns=True)
    earlier = F.lag("_last").over(W.partitionBy("vendor").orderBy("_span", F.col("_first").asc_nulls_first()))
    found = spans.select("_first.row_index", whole_days(earlier, F.col("_first.date")).alias("days"))
    return found.filter(F.col("days") > limit)


def new_vendor_rows(ledger: DataFrame, params: dict | None = None, before: DataFrame | None = None) -> DataFrame:
    """High amounts within n whole days of the first complete row of a vendor.

    `before` (vendor, first_date) stands for earlier rows that are not in `ledger`.
    """
    p = params_with(params)
    complete = with_values(ledger, ["vendor", "date", "amount"])
    high = exceeds(F.col("amount"), p["new_vendor_high_value"])
    firsts = complete.groupBy("vendor").agg(F.min("date").alias("_first_date"), F.count_if(high).alias("_n"))
    if before is not None:
        known = before.select("vendor", F.col("first_date").alias("_before"))
        firsts = firsts.join(known, "vendor", "left").withColumn("_first_date", F.least("_first_date", "_before")).drop("_before")
    vendors = firsts.filter((F.col("_n") > 0) & F.col("_first_date").isNotNull())
    hits = salted_join(
        complete.filter(high), vendors.select("vendor", "_first_date"), ["vendor"], vendors, "_n", F.col("row_index")
    )
    return (
        hits.withColumn("days", whole_days(F.col("_first_date"), F.col("date")))
        .filter(F.col("days") <= p["new_vendor_window_days"])
        .select(*snapshot_columns(ledger), "days")
    )


def vendor_concentration(ledger: DataFrame, params: dict | None = None) -> DataFrame:
    """Vendors above the given share of total absolute spend."""
    exact, loose = exact_parts(F.abs("amount"))
    spend = with_values(ledger, ["vendor", "amount"]).groupBy("vendor").agg(exact.alias("_exact"), loose.alias("_loose"))
    parts = F.col("_exact"), F.col("_loose")
    total = spend.agg(either_part(*merged_parts(*parts))).scalar()
    return (
        spend.select("vendor", either_part(*parts).alias("vendor_spend"), total.alias("total_spend"))
        .withColumn("concentration_pct", F.try_divide(F.col("vendor_spend"), F.col("total_spend")) * 100)
        .filter(F.col("concentration_pct") > params_with(params)["vendor_concentration_pct"])
    )
