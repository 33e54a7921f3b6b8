"""The whole audit of one ledger: read, clean, profile, map, gate, rules, statistics, score, save."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators import cleaning, findings as fnd, profiling, reports, schema, scoring, statistics
from tallyspark.operators.ledger import narrow, params_with
from tallyspark.functions.names import data_columns
from tallyspark.functions.values import has_columns
from tallyspark.sources import store
from tallyspark.sources.csv_ledger import dense_row_index, read_csv_ledger


@dataclass
class AuditRun:
    """Results of one run; tables are DataFrames over written intermediate data."""

    dataset_id: str
    ledger: DataFrame
    mapping: dict[str, str]
    error: str | None
    cleaning_log: DataFrame
    row_count: int
    folder: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def findings(self) -> DataFrame | None:
        return self.tables.get("findings")

    @property
    def finding_rows(self) -> DataFrame | None:
        return self.tables.get("finding_rows")

    def discard(self) -> None:
        """Remove the intermediate tables; the DataFrames of this run cannot be read afterwards."""
        store.remove_folder(self.ledger.sparkSession, self.folder)


def run_audit(
    spark: SparkSession,
    source: str | DataFrame,
    dataset_id: str,
    rule_ids: list[str] | None = None,
    params: dict | None = None,
    mapping: dict[str, str] | None = None,
    compat: bool = True,
    multi_line: bool | None = None,
    dense: bool = False,
) -> AuditRun:
    """Audit a CSV path or an all-text DataFrame with `row_index`.

    The raw, distinct and typed ledgers are each written once to the shared
    scratch folder: later steps read columns of a Parquet table instead of repeating
    the work before, and a lost executor costs one task, not the whole lineage.
    `mapping` overrides the inferred roles, also on a rerun. `dense` renumbers rows to 0, 1, 2, ... after cleaning.
    """
    folder = store.scratch_folder(spark)
    stage = lambda df, name: store.staged(df, folder, name)

    raw = read_csv_ledger(spark, source, multi_line) if isinstance(source, str) else source
    raw = stage(raw, "raw_text")
    cleaned = cleaning.clean(raw, stage, compat)
    typed = stage(dense_row_index(cleaned.ledger) if dense else cleaned.ledger, "typed")
    roles = mapping if mapping is not None else schema.infer_mapping(typed, dataset_id)
    ledger = schema.apply_mapping(typed, roles)
    row_count = typed.count()

    sizes = spark.createDataFrame(
        [(dataset_id, row_count, len(data_columns(ledger)), len(roles))],
        "dataset_id string, row_count bigint, column_count int, role_count int",
    )
    error = schema.quality_gate(sizes).first()["error"]
    run = AuditRun(dataset_id, ledger, roles, error, cleaned.log, row_count, folder)
    columns = profiling.profile_columns(typed)
    run.tables |= {
        "profile_columns": columns,
        "profile_samples": profiling.profile_samples(typed),
        "profile_numeric": profiling.profile_numeric(typed),
        "profile_dates": profiling.profile_dates(typed),
        "profile_dataset": profiling.profile_dataset(columns),
    }
    if error:
        return run

    p = params_with(params)
    slim = narrow(ledger)
    pairs = fnd.payment_pairs(ledger, rule_ids, p, stage)
    found = scoring.score(fnd.findings(ledger, rule_ids, p, pairs), p)
    run.tables |= {
        "findings": store.with_finding_ids(stage(found, "findings"), dataset_id),
        "finding_rows": fnd.row_snapshot_json(fnd.finding_rows(ledger, rule_ids, p, pairs)),
    }
    run.tables["summary"] = reports.run_summary(run.findings, row_count)
    if has_columns(slim, ["amount"]):
        run.tables |= {
            "amount_summary": statistics.amount_summary(slim, p),
            "amount_moments": statistics.amount_moments(slim),
            "outliers_zscore": statistics.zscore_outliers(slim, p),
            "outliers_iqr": statistics.iqr_outliers(slim),
        }
    if has_columns(slim, ["vendor", "amount"]):
        run.tables["vendor_variance"] = statistics.vendor_variance(slim)
        if has_columns(slim, ["date"]):
            run.tables |= {
                "vendor_trend": statistics.vendor_trend(slim),
                "vendor_spikes": statistics.vendor_spikes(slim),
            }
    return run


def save(run: AuditRun, root: str) -> None:
    """Write the run under `root`, replacing any earlier run of the same dataset and nothing else; all tables at once."""
    spark = run.ledger.sparkSession
    roles = spark.createDataFrame(list(run.mapping.items()) or [], "role string, source string")
    tables = {"ledger": run.ledger, "mapping": roles, "cleaning_log": run.cleaning_log, **run.tables}
    store.write_tables(tables, root, run.dataset_id)
