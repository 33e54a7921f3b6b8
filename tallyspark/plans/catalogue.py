"""The registered queries: each runs an operator over whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.operators import (
    adhoc, amounts, cleaning, duplicates, findings as fnd, payment_history, profiling, reports, review, row_rules, schema,
    scoring, sketches, statistics, text_index, vendor_state, vendors,
)
from tallyspark.plans import portable as data
from tallyspark.sources import clustered, csv_ledger, store, version_log
from tallyspark.streaming import ledger_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- sources and sinks


@registered
def ingest_csv(spark, sf):
    folder = store.scratch_folder(spark)
    raw = data.raw_ledger(spark, sf)
    (
        raw.withColumnRenamed("row_index", " key ")
        .write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(f"{folder}/raw")
    )
    return csv_ledger.read_csv_ledger(spark, f"{folder}/raw").drop("row_index")


@registered
def write_read_parquet(spark, sf):
    folder = store.scratch_folder(spark)
    store.write_partition(data.ledger(spark, sf), folder, "ledger", "one")
    return store.read_partition(spark, folder, "ledger", "one")


def _reviewed(spark, sf) -> DataFrame:
    scored = scoring.score(data.findings(spark, sf))
    return review.with_status(scored, data.reviews(spark, sf))


@registered
def findings_export(spark, sf):
    return reports.export_view(_reviewed(spark, sf))


def _saved(found, folder, dataset_id):
    store.write_partition(store.with_finding_ids(found, dataset_id), folder, "findings", dataset_id)


@registered
def persist_findings(spark, sf):
    """All rules for two datasets; a rerun of one with fewer rules replaces its findings and no others."""
    folder, ledger, stage = store.scratch_folder(spark), written_ledger(spark, sf), _stage(spark)
    found = stage(scoring.score(fnd.findings(ledger, pairs=fnd.payment_pairs(ledger, stage=stage))), "findings")
    _saved(found, folder, "one"), _saved(found, folder, "two")
    _saved(scoring.score(fnd.findings(ledger, ["THRESHOLD_BREACH", "SPLIT_TRANSACTION"])), folder, "one")
    return store.read_table(spark, folder, "findings").groupBy("dataset_id", "rule_id", "status").agg(
        F.count_distinct("finding_id").alias("n_findings"), F.sum("n_rows").alias("n_rows")
    )


def _split_findings(spark, sf) -> DataFrame:
    return _stage(spark)(scoring.score(fnd.findings(written_ledger(spark, sf), ["SPLIT_TRANSACTION"])), "findings")


@registered
def rerun_reset(spark, sf):
    """Reviews settle the findings of one run; the next run of the dataset starts pending again."""
    folder, found = store.scratch_folder(spark), _split_findings(spark, sf)

    def status(moment):
        found = store.read_table(spark, folder, "findings")
        folded = review.current_status(found, store.read_reviews(spark, folder))
        counts = folded.groupBy("status").agg(F.count(F.lit(1)).alias("n_findings"))
        return store.staged(counts.select(F.lit(moment).alias("moment"), "status", "n_findings"), folder, "status")

    _saved(found, folder, "one")
    store.append_reviews(store.read_table(spark, folder, "findings").select(
        "dataset_id", "finding_id", F.monotonically_increasing_id().alias("id"), F.lit("CONFIRM").alias("action"),
        F.lit("2024-05-07").cast("timestamp_ntz").alias("created_at"),
    ), folder)
    before = status("reviewed before")
    _saved(found, folder, "one")
    return before.unionByName(status("after the rerun"))


@registered
def delete_then_rerun(spark, sf):
    """A deleted dataset is hidden until it is written again."""
    folder, found = store.scratch_folder(spark), _split_findings(spark, sf)

    for dataset_id in ("one", "two"):
        _saved(found, folder, dataset_id)
    store.delete_datasets(spark.createDataFrame([("one",)], "dataset_id string"), folder)
    deleted = _counts(spark, folder, "deleted")
    _saved(found, folder, "one")
    return deleted.unionByName(_counts(spark, folder, "written again"))


def _counts(spark, folder, moment):
    by_id = store.read_table(spark, folder, "findings").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_findings"))
    return store.staged(by_id.select(F.lit(moment).alias("moment"), "dataset_id", "n_findings"), folder, "counts")


@registered
def interleaved_writers(spark, sf):
    """Two runs of a dataset are written side by side; the one that commits last holds, and one based on an older state is refused."""
    folder, found = store.scratch_folder(spark), _split_findings(spark, sf)
    few = found.filter("n_rows > 2")
    since = version_log.last_number(spark, folder)
    slow, fast = store.prepare(found, folder, "findings", "one"), store.prepare(few, folder, "findings", "one")
    version_log.commit(spark, folder, [fast])
    before = _counts(spark, folder, "first commit")
    version_log.commit(spark, folder, [slow])
    try:
        version_log.commit(spark, folder, [store.prepare(few, folder, "findings", "one")], since)
        last = "not refused"
    except version_log.CommitConflict:
        last = "second commit"
    return before.unionByName(_counts(spark, folder, last))


@registered
def purge_versions(spark, sf):
    """Version folders and findings after three runs of one dataset and one of another, before and after the purge."""
    folder, found = store.scratch_folder(spark), _split_findings(spark, sf)
    for dataset_id in ("one", "one", "two", "one"):
        store.write_partition(found, folder, "findings", dataset_id)

    def stock(moment):
        folders = store.stored_versions(spark, folder).groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("n_versions"), F.count_if("current").alias("n_current"))
        return store.staged(_counts(spark, folder, moment).join(folders, "dataset_id"), folder, "stock")

    before = stock("before")
    store.purge_versions(spark, folder, older_than_hours=-1)
    return before.unionByName(stock("after"))


@registered
def latest_per_dataset(spark, sf):
    versions = data.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("profile"),
    )
    return store.latest_per_dataset(versions)


@registered
def cascade_delete(spark, sf):
    tables = {
        "datasets": data.datasets(spark, sf), "findings": data.findings(spark, sf), "reviews": data.reviews(spark, sf),
    }
    deleted = data.table(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("dataset_id"))
    kept = store.cascade(tables, deleted)
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in kept.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- cleaning


@registered
def clean_strip(spark, sf):
    return cleaning.strip_cells(data.raw_ledger(spark, sf))


def _guarded(spark, sf) -> DataFrame:
    return cleaning.guard_cells(cleaning.strip_cells(data.raw_ledger(spark, sf)))


@registered
def clean_sanitize(spark, sf):
    return _guarded(spark, sf)


@registered
def clean_nulls(spark, sf):
    return cleaning.null_cells(_guarded(spark, sf))


@registered
def clean_dedup(spark, sf):
    return cleaning.drop_copies(cleaning.null_cells(_guarded(spark, sf)))


@registered
def detect_types(spark, sf):
    votes = cleaning.detect_types(cleaning.drop_copies(cleaning.null_cells(_guarded(spark, sf))))
    return _rounded(votes, 6, "numeric_share", "date_share")


@registered
def clean_numeric(spark, sf):
    cells = cleaning.null_cells(_guarded(spark, sf))
    return cleaning.coerce(cells, {"amount_raw": "numeric"}).select("row_index", F.col("amount_raw").alias("amount"))


@registered
def clean_dates(spark, sf):
    cells = cleaning.null_cells(_guarded(spark, sf))
    return cleaning.coerce(cells, {"date_raw": "date"}).select("row_index", F.col("date_raw").alias("date"))


@registered
def cleaning_log(spark, sf):
    return cleaning.cleaning_log(data.raw_ledger(spark, sf))


# --- profiling


@registered
def profile_columns(spark, sf):
    return profiling.profile_columns(data.ledger(spark, sf))


@registered
def profile_samples(spark, sf):
    return profiling.profile_samples(data.ledger(spark, sf))


@registered
def profile_numeric(spark, sf):
    return _rounded(profiling.profile_numeric(data.ledger(spark, sf)), 4, "mean", "median", "std")


@registered
def profile_dates(spark, sf):
    return profiling.profile_dates(data.ledger(spark, sf))


@registered
def profile_dataset(spark, sf):
    return profiling.profile_dataset(profiling.profile_columns(data.ledger(spark, sf)))


@registered
def quality_summary(spark, sf):
    return profiling.quality_summary(profiling.profile_columns(data.ledger(spark, sf)))


@registered
def profile_sketches(spark, sf):
    """Sketches of the ledger's years, stored one by one and merged; distinct counts are held against exact ones."""
    root, ledger = store.scratch_folder(spark), data.ledger(spark, sf)
    year = F.coalesce(F.year("date"), F.lit(0))
    for first, after in ((0, 1994), (1994, 1996), (1996, 9999)):
        part = sketches.sketch_profile(ledger.filter((year >= first) & (year < after)))
        store.write_partition(part, root, "profile_sketches", str(first))
    merged = sketches.estimated(sketches.merged_profiles(store.read_table(spark, root, "profile_sketches")))
    exact = profiling.profile_columns(ledger).select("column", F.col("unique_count").alias("_exact"))
    near = F.abs(F.col("unique_count") - F.col("_exact")) <= F.greatest(F.lit(1.0), F.col("_exact") * sketches.ERROR_BOUND)
    return merged.join(exact, "column").select("ordinal", "column", "row_count", "null_count", "null_pct", near.alias("within_bound"))


@registered
def column_heavy_hitters(spark, sf):
    """Top vendors, customers of orders (no value stands out) and parts of line items; the last two have many values."""
    stage, found = _stage(spark), None
    lines, orders = data.table(spark, sf, "lineitem"), data.table(spark, sf, "orders")
    for df, name in ((data.ledger(spark, sf), "vendor"), (orders, "o_custkey"), (lines, "l_partkey")):
        top = sketches.heavy_hitters(df, name, stage=stage).values.select(F.lit(name).alias("column"), "value", "n")
        found = top if found is None else found.unionByName(top)
    return found


# --- schema


@registered
def role_candidates(spark, sf):
    return schema.role_candidates(data.columns(spark, sf)).drop("role_order")


@registered
def role_mapping(spark, sf):
    return schema.assign_roles(schema.role_candidates(data.columns(spark, sf)))


@registered
def canonicalize(spark, sf):
    source = data.ledger(spark, sf).drop("timestamp").withColumnsRenamed({
        "invoice_no": "inv_no", "vendor": "vendor_name", "amount": "Amount", "date": "transaction_date",
    })
    return schema.apply_mapping(source, schema.infer_mapping(source))


@registered
def quality_gate(spark, sf):
    sizes = data.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("row_count")
    ).withColumns({"column_count": F.col("dataset_id") % 4, "role_count": F.col("dataset_id") % 3})
    return schema.quality_gate(sizes)


# --- rules


def _narrow(spark, sf) -> DataFrame:
    return fnd.narrow(data.ledger(spark, sf))


def _stage(spark):
    folder = store.scratch_folder(spark)
    return lambda df, name: store.staged(df, folder, name)


def written_ledger(spark, sf) -> DataFrame:
    """The narrow ledger as a written table, as in an audit run: rules that scan it many times derive it once."""
    return _stage(spark)(_narrow(spark, sf), "ledger")


@registered
def rule_duplicate_invoice(spark, sf):
    return duplicates.duplicate_invoices(_narrow(spark, sf))


@registered
def rule_duplicate_payment(spark, sf):
    pairs = duplicates.duplicate_payments(_narrow(spark, sf), stage=_stage(spark))
    return pairs.select("vendor", "amount", "row_a", "row_b", "days_apart")


@registered
def rule_sequential_gap(spark, sf):
    gap = duplicates.sequential_gap(_narrow(spark, sf))
    whole = ["first_number", "last_number", "actual_count", "expected_count", "missing_count"]
    return gap.select(*[F.col(c).cast("bigint").alias(c) for c in whole], "gap_pct")


@registered
def sequential_gap_missing(spark, sf):
    return duplicates.missing_numbers(_narrow(spark, sf)).select(F.col("missing_number").cast("bigint").alias("missing_number"))


@registered
def rule_missing_required_field(spark, sf):
    rows = row_rules.rows_of(_narrow(spark, sf), "MISSING_REQUIRED_FIELD")
    return rows.select("row_index", F.concat_ws(",", "missing_fields").alias("missing_fields"))


@registered
def rule_weekend_posting(spark, sf):
    return row_rules.rows_of(_narrow(spark, sf), "WEEKEND_POSTING").select("row_index", "date")


@registered
def rule_public_holiday(spark, sf):
    return row_rules.rows_of(_narrow(spark, sf), "PUBLIC_HOLIDAY_POSTING").select("row_index", "date")


@registered
def rule_after_hours(spark, sf):
    return row_rules.rows_of(_narrow(spark, sf), "AFTER_HOURS_ENTRY").select("row_index", "timestamp")


@registered
def rule_backdated(spark, sf):
    return row_rules.rows_of(_narrow(spark, sf), "BACKDATED_ENTRY").select("row_index", "date", "entry_date", "days")


@registered
def rule_round_dollar(spark, sf):
    return row_rules.rows_of(_narrow(spark, sf), "ROUND_DOLLAR").select("row_index", "amount")


@registered
def rule_threshold_breach(spark, sf):
    return row_rules.rows_of(_narrow(spark, sf), "THRESHOLD_BREACH").select("row_index", "amount")


@registered
def rule_split_transaction(spark, sf):
    return amounts.split_transactions(_narrow(spark, sf))


@registered
def benford_digits(spark, sf):
    return _rounded(amounts.digit_table(_narrow(spark, sf)), 6, "expected").drop("sample_size")


@registered
def rule_benford(spark, sf):
    test = amounts.benford(_narrow(spark, sf)).select("sample_size", "chi_squared", "p_value", "worst_digit")
    return _rounded(_rounded(test, 4, "chi_squared"), 10, "p_value")


@registered
def benford_evidence(spark, sf):
    return amounts.benford_evidence(_narrow(spark, sf)).select("row_index", "amount")


@registered
def rule_dormant_vendor(spark, sf):
    return vendors.dormant_vendor_rows(_narrow(spark, sf)).select("row_index", "vendor", "date", "days")


@registered
def rule_new_vendor_high_value(spark, sf):
    return vendors.new_vendor_rows(_narrow(spark, sf)).select("row_index", "vendor", "amount", "days")


@registered
def rule_vendor_concentration(spark, sf):
    return vendors.vendor_concentration(_narrow(spark, sf))


@registered
def duplicate_payment_batches(spark, sf):
    """Four batches, each compared with itself and with the stored ones before."""
    folder, ledger = store.scratch_folder(spark), written_ledger(spark, sf)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    history, found = payment_history.PaymentHistory(spark, f"{folder}/history", buckets), None
    for number in range(4):
        batch = ledger.filter(F.pmod(F.crc32(F.col("row_index").cast("string")), F.lit(4)) == number)
        pairs = duplicates.unfolded(history.add(number, batch))  # the history has written the pairs of cells
        found = pairs if found is None else found.unionByName(pairs)
    history.close()
    return found.select("vendor", "amount", "row_a", "row_b", "days_apart")


@registered
def vendor_rule_batches(spark, sf):
    """Three batches in the order of their dates; only the vendor summary passes from one to the next."""
    root, ledger, found = store.scratch_folder(spark), written_ledger(spark, sf), None
    for first, after in ((None, 1994), (1994, 1996), (1996, None)):
        year = F.year("date")
        here = year >= first if first else F.lit(True)
        batch = ledger.filter(here & (year < after) if after else here)
        hits = vendor_state.audit_batch(batch, root, "ledger")
        rows = hits.dormant.select(F.lit("DORMANT_VENDOR").alias("rule_id"), "row_index", "days").unionByName(
            hits.new_vendors.select(F.lit("NEW_VENDOR_HIGH_VALUE").alias("rule_id"), "row_index", "days"))
        found = rows if found is None else found.unionByName(rows)
    return found


@registered
def finding_rows(spark, sf):
    ledger = written_ledger(spark, sf)
    rows = fnd.finding_rows(ledger, pairs=fnd.payment_pairs(ledger, stage=_stage(spark)))
    return rows.select(
        "rule_id", "row_index", "invoice_no", "vendor", "amount", "date", "entry_date", "timestamp", "days",
        F.concat_ws(",", "missing_fields").alias("missing_fields"),
    )


def scored_findings(spark, sf) -> DataFrame:
    ledger = written_ledger(spark, sf)
    return scoring.score(fnd.findings(ledger, pairs=fnd.payment_pairs(ledger, stage=_stage(spark))))


@registered
def findings_all(spark, sf):
    return _rounded(scored_findings(spark, sf), 4, "total_exposure", "p_value", "concentration_pct", "gap_pct").select(
        "rule_id", "rule_name", "severity", "n_rows", "total_exposure", "duplicate_count", "p_value",
        "concentration_pct", "threshold_pct", "gap_pct", "audit_explanation", "risk_score",
    )


# --- values at the edge


def _extreme(spark, sf) -> DataFrame:
    return fnd.narrow(data.extreme_ledger(spark, sf))


@registered
def extreme_gap(spark, sf):
    return _rounded(duplicates.sequential_gap(_extreme(spark, sf)), 6, "gap_pct")


@registered
def extreme_missing(spark, sf):
    return duplicates.missing_numbers(_extreme(spark, sf))


@registered
def extreme_concentration(spark, sf):
    found = vendors.vendor_concentration(_extreme(spark, sf)).select("vendor", "concentration_pct")
    return _rounded(found, 6, "concentration_pct")


@registered
def extreme_monthly(spark, sf):
    vast = F.when(F.col("vendor") == "Vast", F.round(F.col("total") / 1e20, 3)).otherwise(F.col("total"))
    return statistics.vendor_monthly(_extreme(spark, sf)).withColumn("total", vast)


@registered
def extreme_split(spark, sf):
    groups = amounts.split_transactions(_extreme(spark, sf))
    return groups.select("vendor", "date", "transaction_count", F.round(F.col("total_amount") / 1e20, 3).alias("total"))


# --- statistics


@registered
def stats_amount(spark, sf):
    summary = statistics.amount_summary(_narrow(spark, sf))
    return _rounded(summary, 4, "mean", "median", "std", "p95", "p99", "iqr_lower_fence", "iqr_upper_fence")


@registered
def stats_moments(spark, sf):
    return _rounded(statistics.amount_moments(_narrow(spark, sf)), 6, "skewness", "kurtosis")


@registered
def outliers_zscore(spark, sf):
    return _rounded(statistics.zscore_outliers(_narrow(spark, sf)), 6, "zscore")


@registered
def outliers_iqr(spark, sf):
    return _rounded(statistics.iqr_outliers(_narrow(spark, sf)), 6, "lower_fence", "upper_fence")


@registered
def vendor_monthly(spark, sf):
    return statistics.vendor_monthly(_narrow(spark, sf))


@registered
def top_vendors(spark, sf):
    return statistics.top_vendors(_narrow(spark, sf))


@registered
def vendor_trend(spark, sf):
    return statistics.vendor_trend(_narrow(spark, sf))


@registered
def vendor_spikes(spark, sf):
    return statistics.vendor_spikes(_narrow(spark, sf))


@registered
def vendor_variance(spark, sf):
    return statistics.vendor_variance(_narrow(spark, sf))


# --- scores


@registered
def risk_score(spark, sf):
    return scoring.score(data.findings(spark, sf)).select("finding_id", "risk_score")


@registered
def risk_justification(spark, sf):
    return scoring.score(data.findings(spark, sf)).select("finding_id", "risk_justification")


# --- findings and reviews


@registered
def findings_ranked(spark, sf):
    return reports.ranked(scoring.score(data.findings(spark, sf))).select("finding_id", "dataset_id", "risk_score")


@registered
def findings_search(spark, sf):
    found = reports.search(
        _reviewed(spark, sf), data.datasets(spark, sf), severity="HIGH", status="PENDING", text="Urgent"
    ).unionByName(reports.search(_reviewed(spark, sf), data.datasets(spark, sf), severity="LOW", text="customer#"))
    return found.select("finding_id", "dataset_name", "severity", "status")


@registered
def findings_search_index(spark, sf):
    """The searches of `findings_search`, by postings."""
    folder = f"{store.scratch_folder(spark)}/index"
    rows = reports.with_dataset_names(_reviewed(spark, sf), data.datasets(spark, sf))
    columns = ["rule_name", "audit_explanation", "dataset_name"]
    text_index.write_index(rows, folder, columns, ["rule_name", "dataset_name"], 32)
    found = [
        text_index.search_index(spark, folder, columns, needle).filter(keep)
        for needle, keep in (("Urgent", "severity = 'HIGH' AND status = 'PENDING'"), ("customer#", "severity = 'LOW'"))]
    return found[0].unionByName(found[1]).select("finding_id", "dataset_name", "severity", "status")


@registered
def findings_sorted(spark, sf):
    return reports.sorted_by(data.findings(spark, sf), "severity").select("finding_id", "severity", "n_rows")


@registered
def findings_by_dataset(spark, sf):
    return reports.by_dataset(data.findings(spark, sf), data.datasets(spark, sf))


@registered
def findings_by_rule(spark, sf):
    return reports.by_rule(scoring.score(data.findings(spark, sf)))


@registered
def dashboard_kpis(spark, sf):
    return reports.dashboard(data.datasets(spark, sf), _reviewed(spark, sf))


@registered
def dataset_list(spark, sf):
    return reports.dataset_list(data.datasets(spark, sf))


@registered
def run_summary(spark, sf):
    rows = data.table(spark, sf, "orders").agg(F.count(F.lit(1))).scalar()
    return reports.run_summary(data.findings(spark, sf), rows)


@registered
def review_status(spark, sf):
    return review.current_status(data.findings(spark, sf), data.reviews(spark, sf))


@registered
def review_pending(spark, sf):
    return review.pending(data.findings(spark, sf), data.reviews(spark, sf))


@registered
def review_bulk(spark, sf):
    selected = data.reviews(spark, sf).filter(F.col("action") == "DISMISS")
    log = review.bulk_review(data.findings(spark, sf), selected, "confirm", "auditor")
    return log.select("finding_id", "action", "reviewer")


@registered
def review_history(spark, sf):
    return review.history(review.valid_actions(data.reviews(spark, sf)))


@registered
def finding_evidence(spark, sf):
    rows = data.ledger(spark, sf).filter("vendor IS NOT NULL").select(
        F.col("vendor").alias("finding_key"), "row_index", "amount"
    )
    return reports.evidence(rows)


@registered
def enrichment_payload(spark, sf):
    found = data.findings(spark, sf).select(
        F.col("dataset_id").alias("finding_key"), "finding_no", "finding_id", "severity"
    )
    rows = data.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("finding_key"), F.col("o_orderkey").alias("row_index"),
        F.col("o_totalprice").alias("amount"),
    )
    payload = reports.enrichment_payload(found, rows, ["finding_no"])

    def part(path: str) -> Column:
        return F.get_json_object("payload", path)

    return payload.select(
        part("$.finding_id").alias("finding_id"), part("$.severity").alias("severity"),
        part("$.sample_flagged_rows[0].row_index").cast("bigint").alias("first_row"),
        part("$.sample_flagged_rows[2].row_index").cast("bigint").alias("third_row"),
        part("$.sample_flagged_rows[3].row_index").cast("bigint").alias("fourth_row"),
    )


# --- streams

#: Days by which rows of the test stream arrive late, and its arrival by years.
LATE_DAYS, ARRIVALS = 60, [(None, 1994), (1994, 1996), (1996, 1998), (1998, None)]


def _arriving(spark, sf, found, table, last_row=False) -> DataFrame:
    """Files of the ledger arrive in parts, rows out of order by up to LATE_DAYS; the query starts again for each part.

    `found` makes the stream of hits of a stream of rows. `last_row`: a row with nothing but a late date follows.
    """
    folder, ledger = store.scratch_folder(spark), written_ledger(spark, sf)
    late = F.make_dt_interval((F.col("row_index") % LATE_DAYS).cast("int"))
    year = F.year(F.col("date") + late)
    files, root = f"{folder}/arriving", f"{folder}/store"

    def drain():
        hits = found(ledger_stream.ledger_files(spark, files, ledger.schema))
        ledger_stream.into_store(hits, root, table, "arriving", f"{folder}/checkpoint").awaitTermination()

    for first, after in ARRIVALS:
        here = F.coalesce(year >= first if first else F.lit(True), F.lit(first is None))
        here &= F.coalesce(year < after, F.lit(False)) if after else F.lit(True)
        ledger.filter(here).write.mode("append").parquet(files)
        drain()
    if last_row:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in ledger.schema if f.name not in ("row_index", "date")]
        end = ledger.agg(F.max("date").alias("date")).select(F.lit(-1).cast("bigint").alias("row_index"), (F.col("date") + F.expr(f"INTERVAL {LATE_DAYS + 2} DAYS")).alias("date"), *blank)
        end.select(ledger.columns).write.mode("append").parquet(files)
        drain()
    return store.read_partition(spark, root, table, "arriving")


@registered
def stream_row_rules(spark, sf):
    return _arriving(spark, sf, ledger_stream.flagged_rows, "finding_rows").select("rule_id", "row_index")


@registered
def stream_duplicate_payment(spark, sf):
    return _arriving(spark, sf, lambda rows: ledger_stream.duplicate_payments(rows, f"{LATE_DAYS} days"), "pairs")


@registered
def stream_split_transaction(spark, sf):
    return _arriving(spark, sf, lambda rows: ledger_stream.split_transactions(rows, f"{LATE_DAYS} days"), "splits", last_row=True)


# --- ad-hoc queries

SQL_GROUP = (
    "SELECT vendor, COUNT(*) AS n, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total "
    "FROM dataset WHERE amount > 1000 GROUP BY vendor ORDER BY vendor"
)
SQL_CTE = (
    "WITH big AS (SELECT * FROM dataset WHERE amount > 400000), v AS (SELECT vendor, COUNT(*) AS n FROM big GROUP BY vendor) "
    "SELECT COUNT(*) AS vendors, MAX(n) AS most FROM v"
)
SQL_LIMIT = "SELECT row_index, amount FROM dataset ORDER BY row_index"


@registered
def sql_group(spark, sf):
    return adhoc.query_ledger(data.ledger(spark, sf), SQL_GROUP, limit=None)


@registered
def sql_cte(spark, sf):
    return adhoc.query_ledger(data.ledger(spark, sf), SQL_CTE, limit=None)


@registered
def sql_limit(spark, sf):
    return adhoc.query_ledger(data.ledger(spark, sf), SQL_LIMIT, fv.TOOL_ROW_CAP)


@registered
def vendor_summary(spark, sf):
    return statistics.vendor_summary(_narrow(spark, sf))


@registered
def vendor_lookup(spark, sf):
    """The summary of one vendor and the postings of one invoice from a clustered ledger."""
    folder = f"{store.scratch_folder(spark)}/clustered"
    clustered.write_clustered(data.ledger(spark, sf), folder, "vendor", ["invoice_no"], distinct=100_000)
    vendor = data.table(spark, sf, "customer").filter("c_custkey % 9 >= 4").agg(F.min("c_name")).first()[0]
    invoice = data.table(spark, sf, "orders").filter("o_orderkey % 13 <> 0").agg(F.max("o_orderkey")).first()[0]
    rows = clustered.lookup(spark, folder, "vendor", vendor)
    posted = clustered.lookup(spark, folder, "invoice_no", f"INV-{100000 + invoice}")
    facts = lambda df, kind: df.agg(F.lit(kind).alias("lookup"), F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(28,6)")).cast("double").alias("total"))
    return facts(rows, "vendor").unionByName(facts(posted, "invoice"))


@registered
def column_stats(spark, sf):
    stats = profiling.column_stats(data.table(spark, sf, "lineitem"), "l_extendedprice")
    return _rounded(_rounded(stats, 4, "mean", "std"), 6, "median", "q1", "q3")


@registered
def column_top_values(spark, sf):
    return profiling.column_top_values(data.ledger(spark, sf), "vendor")


@registered
def schema_digest(spark, sf):
    ledger = data.ledger(spark, sf)
    return profiling.schema_digest(profiling.profile_columns(ledger), profiling.profile_samples(ledger))
