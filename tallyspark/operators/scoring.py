"""Risk score of a finding from its severity and typed metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.values import lookup
from tallyspark.operators.ledger import params_with


def _capped(cap: float, value: Column, present: Column) -> Column:
    """min(cap, value), or 0 where the metric is absent (`least` alone would skip the NULL)."""
    return F.when(present, F.least(F.lit(float(cap)), value)).otherwise(F.lit(0.0))


def boost(params: dict | None = None) -> Column:
    """Sum of the metric boosts."""
    threshold = float(params_with(params)["materiality_threshold"])
    exposure, copies, p, share, gap = (
        F.col(c).cast("double")
        for c in ("total_exposure", "duplicate_count", "p_value", "concentration_pct", "gap_pct")
    )
    share_limit = F.coalesce(F.col("threshold_pct").cast("double"), F.lit(40.0))
    at_least_zero = lambda c: F.greatest(F.lit(0.0), c)
    parts = [
        _capped(10, exposure / threshold * 5, exposure.isNotNull()),
        _capped(5, at_least_zero(copies - 2) * 2, copies.isNotNull()),
        _capped(10, (0.05 - p) * 100, p.isNotNull() & (p < 0.05)),
        _capped(10, at_least_zero(share - share_limit) / 2, share.isNotNull()),
        _capped(10, at_least_zero(gap - 5) / 2, gap.isNotNull()),
    ]
    return reduce(lambda a, b: a + b, parts)


def score(findings: DataFrame, params: dict | None = None) -> DataFrame:
    """Add risk_score (0-100, half-even rounding) and risk_justification."""
    severity = F.coalesce(F.col("severity"), F.lit("MEDIUM"))
    base = lookup(fv.SEVERITY_BASE, severity, F.lit(fv.UNKNOWN_SEVERITY_BASE))
    rounded = F.bround(F.col("_boost"), 1)
    signed = F.when(rounded < 0, F.format_string("%.1f", rounded)).otherwise(F.format_string("+%.1f", F.abs(rounded)))
    return (
        findings.withColumn("_boost", boost(params))
        .withColumn("risk_score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(base + F.col("_boost")).cast("int"))))
        .withColumn(
            "risk_justification",
            F.format_string(
                fv.JUSTIFICATION_FORMAT, severity, F.coalesce("rule_name", "rule_id"),
                F.col("n_rows").cast("string"), base.cast("string"), signed,
            ),
        )
        .drop("_boost")
    )
