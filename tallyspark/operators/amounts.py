"""Split transactions and first-digit analysis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.skew import salted_join
from tallyspark.functions.values import chi_square_tail_8df, either_part, exact_parts
from tallyspark.operators.ledger import params_with, snapshot_columns, with_values

SPLIT_KEYS = ["vendor", "date"]


def split_transactions(ledger: DataFrame, params: dict | None = None) -> DataFrame:
    """Vendor and date groups whose signed total is whole and above materiality."""
    p = params_with(params)
    exact, loose = exact_parts(F.col("amount"))
    return whole_totals(
        with_values(ledger, ["vendor", "amount", "date"])
        .groupBy(*SPLIT_KEYS)
        .agg(F.count(F.lit(1)).alias("transaction_count"), exact.alias("_exact"), loose.alias("_loose")), p,
    ).select(*SPLIT_KEYS, "transaction_count", "total_amount")


def whole_totals(groups: DataFrame, p: dict) -> DataFrame:
    """Groups of enough rows whose total is whole and above materiality, judged on the exact total where there is one."""
    whole = F.coalesce(F.col("_exact") % 1 == 0, F.col("_loose") == F.rint("_loose"))
    return (
        groups.filter(F.col("transaction_count") >= p["split_transaction_min_rows"])
        .withColumn("total_amount", either_part(F.col("_exact"), F.col("_loose")))
        .filter((F.col("total_amount") > p["materiality_threshold"]) & whole)
    )


def split_transaction_rows(ledger: DataFrame, params: dict | None = None) -> DataFrame:
    groups = split_transactions(ledger, params)
    hits = salted_join(
        with_values(ledger, ["vendor", "amount", "date"]), groups.select(*SPLIT_KEYS), SPLIT_KEYS,
        groups, "transaction_count", F.col("row_index"),
    )
    return hits.select(*snapshot_columns(ledger))


def first_digit(amount: str = "amount"):
    return F.regexp_extract(F.abs(amount).cast("string"), "[1-9]", 0).try_cast("int")


def digit_table(ledger: DataFrame) -> DataFrame:
    """Nine rows: observed against expected share of each leading digit."""
    digit = first_digit()
    expected_share = {d: math.log10(1 + 1 / d) for d in range(1, 10)}
    counted = with_values(ledger, ["amount"]).filter(F.abs("amount") > 0).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.array(*[
            F.struct(
                F.lit(d).alias("digit"), F.count_if(digit == d).alias("observed"),
                F.lit(expected_share[d]).alias("expected_share"),
            )
            for d in range(1, 10)
        ]).alias("_digits"),
    )
    observed_pct = F.round(F.try_divide(F.col("observed"), F.col("sample_size")) * 100, 2)
    expected_pct = F.round(F.col("expected_share") * 100, 2)
    return (
        counted.select("sample_size", F.explode("_digits").alias("_d"))
        .select("sample_size", "_d.*")
        .withColumn("expected", F.col("expected_share") * F.col("sample_size"))
        .withColumn("observed_pct", observed_pct)
        .withColumn("expected_pct", expected_pct)
        .drop("expected_share")
    )


def benford(ledger: DataFrame, params: dict | None = None) -> DataFrame:
    """At most one row: the chi-squared test over the nine leading digits."""
    gap = F.col("observed") - F.col("expected")
    # Over-representation first, smaller digit on a tie.
    worst = F.max(F.struct(
        F.round(F.col("observed_pct") - F.col("expected_pct"), 2).alias("deviation"),
        (-F.col("digit")).alias("_minus_digit"),
        "digit", "observed", "observed_pct", "expected_pct",
    ))
    return (
        digit_table(ledger)
        .agg(
            F.max("sample_size").alias("sample_size"),
            F.sum(F.try_divide(gap * gap, F.col("expected"))).alias("chi_squared"),
            worst.alias("_worst"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("digit", "observed_pct")))).alias("observed_pct"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("digit", "expected_pct")))).alias("expected_pct"),
        )
        .withColumn("p_value", chi_square_tail_8df(F.col("chi_squared")))
        .filter(
            (F.col("sample_size") >= fv.BENFORD_MIN_ROWS)
            & (F.col("p_value") < params_with(params)["benford_p_value"])
        )
        .select(
            "sample_size", "chi_squared", "p_value", F.col("_worst.digit").alias("worst_digit"),
            F.col("_worst.observed").alias("worst_observed"),
            F.col("_worst.observed_pct").alias("worst_observed_pct"),
            F.col("_worst.expected_pct").alias("worst_expected_pct"),
            "observed_pct", "expected_pct",
        )
    )


def benford_evidence(ledger: DataFrame, params: dict | None = None) -> DataFrame:
    """The first rows carrying the most over-represented digit."""
    worst = benford(ledger, params).select("worst_digit").scalar()
    return (
        with_values(ledger, ["amount"])
        .filter((F.abs("amount") > 0) & (first_digit() == worst))
        .select(*snapshot_columns(ledger))
        .orderBy("row_index").limit(fv.BENFORD_EVIDENCE_ROWS)
    )
