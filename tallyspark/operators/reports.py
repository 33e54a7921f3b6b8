"""Ranked, searched, grouped and exported views of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.skew import salted_join
from tallyspark.functions.values import severity_rank

EXPORT_COLUMNS = [
    "finding_id", "rule_id", "rule_name", "severity", "risk_score", "status", "audit_explanation",
    "llm_enriched_explanation", "flagged_row_count",
]


def ranked(findings: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """By risk score, highest first."""
    rows = findings if dataset_id is None else findings.filter(F.col("dataset_id") == dataset_id)
    return rows.orderBy(F.desc("risk_score"), "finding_id")


def with_dataset_names(findings: DataFrame, datasets: DataFrame) -> DataFrame:
    return findings.join(datasets.select("dataset_id", "dataset_name"), "dataset_id", "left")


def search(
    findings: DataFrame, datasets: DataFrame, severity: str | None = None, status: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Filter by severity, status and a case-insensitive part of rule name, explanation or dataset name."""
    rows = with_dataset_names(findings, datasets)
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if status:
        rows = rows.filter(F.col("status") == status)
    if text and text.strip():
        needle = F.lit(text.lower())
        hit = F.contains(F.lower("rule_name"), needle) | F.contains(F.lower("audit_explanation"), needle)
        rows = rows.filter(hit | F.coalesce(F.contains(F.lower("dataset_name"), needle), F.lit(False)))
    return rows


def sorted_by(findings: DataFrame, key: str = "risk_score", ascending: bool = False) -> DataFrame:
    """Order by rule_name, severity, n_rows, status or risk_score."""
    keys: dict[str, Column] = {
        "rule_name": F.col("rule_name"), "severity": severity_rank(F.col("severity")),
        "n_rows": F.col("n_rows"), "status": F.col("status"), "risk_score": F.col("risk_score"),
    }
    order = keys[key]
    return findings.orderBy(order.asc() if ascending else order.desc(), "finding_id")


def _worst(by: list[str], findings: DataFrame) -> DataFrame:
    """Worst severity and count per group."""
    return (
        findings.groupBy(*by)
        .agg(F.max(severity_rank(F.col("severity"))).alias("_rank"), F.count(F.lit(1)).alias("n_findings"))
        .withColumn("max_severity", F.when(F.col("_rank") == 3, "HIGH").when(F.col("_rank") == 2, "MEDIUM").otherwise("LOW"))
    )


def by_dataset(findings: DataFrame, datasets: DataFrame) -> DataFrame:
    groups = _worst(["dataset_id"], findings)
    names = datasets.select(F.col("dataset_id"), "dataset_name")
    return (
        groups.join(names, "dataset_id", "left")
        .orderBy(F.desc("_rank"), F.desc("n_findings"), "dataset_id")
        .select(
            "dataset_id", F.coalesce("dataset_name", F.col("dataset_id").cast("string")).alias("dataset_name"),
            "max_severity", "n_findings",
        )
    )


def by_rule(findings: DataFrame) -> DataFrame:
    """Every finding under its rule: worst and largest rules first, members by score.

    One global sort instead of a window per rule, so a rule with most findings is
    spread over range partitions; the join splits such a rule as well.
    """
    groups = _worst(["rule_name"], findings)
    return (
        salted_join(findings, groups, ["rule_name"], groups, "n_findings", F.col("finding_id"))
        .orderBy(F.desc("_rank"), F.desc("n_findings"), "rule_name", F.desc("risk_score"), "finding_id")
        .select("rule_name", "max_severity", "n_findings", "finding_id", "severity", "risk_score")
    )


def dashboard(datasets: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts for the front page."""
    n_datasets = datasets.agg(F.count(F.lit(1))).scalar()
    return findings.agg(
        F.count(F.lit(1)).alias("total_findings"), F.count_if(F.col("severity") == "HIGH").alias("high_findings"),
        F.count_if(F.col("status") == "PENDING").alias("pending_findings"),
    ).select(n_datasets.alias("total_datasets"), "total_findings", "high_findings", "pending_findings")


def dataset_list(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.desc("created_at"), "dataset_id")


def run_summary(findings: DataFrame, row_count: int | Column) -> DataFrame:
    """One sentence: findings by severity and the three most frequent rules.

    Rules of equal count keep the order in which they first report.
    """
    rows = (row_count if isinstance(row_count, Column) else F.lit(row_count)).cast("string")
    first = F.min("seq.rule") if "seq" in findings.columns else F.min("rule_name")
    counts = findings.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in fv.SEVERITY_RANK],
    )
    top = (
        findings.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"), first.alias("_first"))
        .orderBy(F.desc("n"), "_first").limit(3)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_rank"), "_first", "rule_name", "n"))).alias("_top"))
        .select(F.concat_ws(", ", F.transform(
            "_top", lambda t: F.concat(t["rule_name"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))
        )))
        .scalar()
    )
    severities = F.concat_ws(", ", *[
        F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in fv.SEVERITY_RANK
    ])
    return counts.select(
        F.when(F.col("n") == 0, F.format_string(fv.SUMMARY_NONE_FORMAT, rows))
        .otherwise(F.format_string(fv.SUMMARY_FORMAT, rows, F.col("n").cast("string"), severities, top))
        .alias("summary")
    )


def export_view(findings: DataFrame) -> DataFrame:
    """The columns of an exported findings file."""
    enriched = F.col("llm_enriched_explanation") if "llm_enriched_explanation" in findings.columns else F.lit(None)
    return findings.select(
        *EXPORT_COLUMNS[:7], enriched.cast("string").alias("llm_enriched_explanation"),
        F.col("n_rows").cast("bigint").alias("flagged_row_count"),
    )


def export_csv(findings: DataFrame, path: str) -> None:
    """Write the export as CSV part files, each with a header."""
    export_view(findings).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def evidence(rows: DataFrame, n: int = fv.EVIDENCE_ROWS) -> DataFrame:
    """The first rows of each finding.

    Spark prunes to n rows per finding inside each map task before the shuffle.
    """
    place = F.row_number().over(W.partitionBy("finding_key").orderBy("row_index"))
    return rows.withColumn("position", place).filter(F.col("position") <= n)


def enrichment_payload(findings: DataFrame, rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The first findings in reporting order as JSON, each with up to three sample rows."""
    first = findings.orderBy(*order).limit(fv.ENRICHED_FINDINGS)
    chosen = F.broadcast(first.select("finding_key"))  # at most ENRICHED_FINDINGS rows
    fields = [c for c in rows.columns if c != "finding_key"]
    samples = (
        evidence(rows.join(chosen, "finding_key", "left_semi"), fv.ENRICHED_ROWS)
        .groupBy("finding_key")
        .agg(F.sort_array(F.collect_list(F.struct("row_index", *[c for c in fields if c != "row_index"]))).alias("sample_flagged_rows"))
    )
    body = [c for c in findings.columns if c not in ("finding_key", "seq")]
    return first.join(samples, "finding_key", "left").select(
        "finding_key",
        F.to_json(F.struct(
            *body, F.coalesce("sample_flagged_rows", F.array().cast(samples.schema["sample_flagged_rows"].dataType))
            .alias("sample_flagged_rows"),
        )).alias("payload"),
    )
