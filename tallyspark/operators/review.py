"""Review actions as an append-only log, folded to the current status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.values import lookup


def valid_actions(log: DataFrame) -> DataFrame:
    """Actions in upper case; anything but CONFIRM, DISMISS and NOTE is refused."""
    return log.withColumn("action", F.upper("action")).filter(F.col("action").isin(fv.REVIEW_ACTIONS))


def refused_actions(log: DataFrame) -> DataFrame:
    return log.filter(~F.coalesce(F.upper("action").isin(fv.REVIEW_ACTIONS), F.lit(False)))


def with_status(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings with their status: the last CONFIRM or DISMISS decides, PENDING without one."""
    last = (
        valid_actions(log).filter(F.col("action") != "NOTE")
        .groupBy("finding_id")
        .agg(F.max(F.struct("created_at", "id", "action")).alias("_last"))
        .select("finding_id", lookup(fv.ACTION_STATUS, F.col("_last.action"), F.lit(None)).alias("status"))
    )
    return findings.drop("status").join(last, "finding_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("PENDING"))
    )


def current_status(findings: DataFrame, log: DataFrame) -> DataFrame:
    """(finding_id, status) of every finding."""
    return with_status(findings.select("finding_id"), log)


def pending(findings: DataFrame, log: DataFrame) -> DataFrame:
    return current_status(findings, log).filter(F.col("status") == "PENDING")


def bulk_review(findings: DataFrame, selected: DataFrame, action: str, reviewer: str | None = None) -> DataFrame:
    """Log rows that apply one action to the selected findings that exist."""
    if action.upper() not in fv.REVIEW_ACTIONS:
        raise ValueError("action must be one of CONFIRM, DISMISS, NOTE")
    known = findings.select("finding_id").join(selected.select("finding_id"), "finding_id", "left_semi")
    return known.select(
        F.uuid().alias("id"), "finding_id", F.lit(action.upper()).alias("action"),
        F.lit(None).cast("string").alias("note"), F.lit(reviewer).cast("string").alias("reviewer"),
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
    )


def history(log: DataFrame, finding_id: str | None = None) -> DataFrame:
    """Review actions in time order, of one finding or all."""
    rows = log if finding_id is None else log.filter(F.col("finding_id") == finding_id)
    return rows.orderBy("created_at", "id")
