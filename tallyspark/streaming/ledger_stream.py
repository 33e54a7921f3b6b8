"""The row, pair and group rules on an unbounded ledger.

The predicates are those of the batch rules; only the source differs. `date` is the
event time, and rows later than the watermark are no longer matched or counted. `into_store`
appends what a stream finds to a table of the store, each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.functions.values import exact_parts, whole_days
from tallyspark.operators import row_rules
from tallyspark.operators.amounts import whole_totals
from tallyspark.operators.ledger import narrow, params_with
from tallyspark.sources import store


def flagged_rows(stream: DataFrame, params: dict | None = None) -> DataFrame:
    """Rows hit by the row-local rules; stateless."""
    ledger = narrow(stream)
    return row_rules.all_rows(ledger, row_rules.row_checks(ledger, params))


def _payments(stream: DataFrame, delay: str) -> DataFrame:
    """Complete rows. The watermark sees all rows, so one that has a date alone moves time on and does nothing else."""
    rows = narrow(stream).withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", delay)
    # One predicate that names the event time: parts without it would be moved below the watermark and take the row away.
    present = F.array_compact(F.array(*[F.col(c).cast("string") for c in ("vendor", "amount", "at")]))
    return rows.filter(F.size(present) == 3)


def duplicate_payments(stream: DataFrame, delay: str = "1 day", params: dict | None = None) -> DataFrame:
    """Pairs of payments within the window as a stream-stream join; state is kept for the window only."""
    window_days = int(params_with(params)["duplicate_payment_window_days"])
    rows = _payments(stream, delay)
    if "invoice_no" not in rows.columns:
        rows = rows.withColumn("invoice_no", F.lit(None).cast("string"))
    names = ["row_index", "vendor", "amount", "date", "invoice_no", "at"]
    a = rows.select(*[F.col(c).alias(f"a_{c}") for c in names])
    b = rows.select(*[F.col(c).alias(f"b_{c}") for c in names])
    c = F.col
    ordered = (c("a_date") < c("b_date")) | ((c("a_date") == c("b_date")) & (c("a_row_index") < c("b_row_index")))
    same_invoice = F.coalesce(c("a_invoice_no") == c("b_invoice_no"), F.lit(False))
    near = (c("b_at") >= c("a_at")) & (c("b_at") < c("a_at") + F.expr(f"INTERVAL {window_days + 1} DAYS"))
    keys = (c("a_vendor") == c("b_vendor")) & (c("a_amount") == c("b_amount"))
    return a.join(b, keys & near & ordered & ~same_invoice).select(
        c("a_vendor").alias("vendor"), c("a_amount").alias("amount"), c("a_row_index").alias("row_a"),
        c("b_row_index").alias("row_b"), whole_days(c("a_date"), c("b_date")).alias("days_apart"),
    )


def split_transactions(stream: DataFrame, delay: str = "1 day", params: dict | None = None) -> DataFrame:
    """Whole daily totals per vendor above materiality, emitted when the watermark passes the day."""
    exact, loose = exact_parts(F.col("amount"))
    groups = _payments(stream, delay).groupBy(F.window("at", "1 day").alias("_day"), "vendor").agg(
        F.count(F.lit(1)).alias("transaction_count"), exact.alias("_exact"), loose.alias("_loose")
    )
    return whole_totals(groups, params_with(params)).select(
        "vendor", F.col("_day.start").cast("date").alias("day"), "transaction_count", "total_amount"
    )


def ledger_files(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, the oldest first."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def into_store(found: DataFrame, root: str, table: str, dataset_id: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the rows of a stream to a table of the store; with `available_now` the query ends when all input is read.

    `checkpoint` is a folder of this stream alone, in storage that all executors share. A query that starts again from it
    goes on where the last one ended. A batch that is repeated after a failure has the same number, by which the
    store knows it, so its rows are there once.
    """
    def write(batch: DataFrame, number: int) -> None:
        store.append_version(batch, root, table, dataset_id, f"batch-{number:012d}")

    writer = found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
