"""What the vendor rules need to know of earlier batches: one row per vendor, carried on instead of the history."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.operators import vendors
from tallyspark.operators.ledger import narrow, with_values
from tallyspark.sources import store, version_log

TABLE = "vendor_state"
_SCHEMA = "vendor string, first_date timestamp_ntz, last_date timestamp_ntz"


class BatchHits(NamedTuple):
    dormant: DataFrame
    new_vendors: DataFrame
    late: DataFrame  # rows older than what an earlier batch had of their vendor: judged as they come, see `audit_batch`


def summary(ledger: DataFrame) -> DataFrame:
    """(vendor, first_date, last_date): the first date of a complete row and the last of any dated row."""
    dated = with_values(ledger, ["vendor", "date"])
    first = F.min(F.when(F.col("amount").isNotNull(), F.col("date")))
    return dated.groupBy("vendor").agg(first.alias("first_date"), F.max("date").alias("last_date"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Summaries of two sets of rows to that of both; in any order and grouping."""
    return a.unionByName(b).groupBy("vendor").agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def stored(spark: SparkSession, root: str, stream: str) -> DataFrame:
    if store.current_versions(spark, root, TABLE).filter(F.col("dataset_id") == stream).isEmpty():
        return spark.createDataFrame([], _SCHEMA)
    return store.read_partition(spark, root, TABLE, stream)


def audit_batch(ledger: DataFrame, root: str, stream: str, params: dict | None = None) -> BatchHits:
    """Dormant and new vendors of a batch, given all batches before, of which only the summary is read.

    If the dates of a vendor do not fall behind those of earlier batches, the batches together give the rows of one full run.
    Rows that do fall behind are reported in `late`: an earlier batch has been judged without them, and a full run may differ in
    rows of their vendors. The results are written before the summary moves on, so a batch that failed can be repeated. One that
    meets another batch committed meanwhile is refused with CommitConflict; one that was committed must not come again.
    """
    spark, folder = ledger.sparkSession, store.scratch_folder(ledger.sparkSession)
    since = version_log.last_number(spark, root)
    before, batch = stored(spark, root, stream), narrow(ledger)
    known = before.select("vendor", "last_date")
    hits = {
        "dormant": vendors.dormant_vendor_rows(batch, params, before),
        "new_vendors": vendors.new_vendor_rows(batch, params, before),
        "late": with_values(batch, ["vendor", "date"]).join(known, "vendor").filter(F.col("date") < F.col("last_date")).drop("last_date"),
    }
    found = BatchHits(**{name: store.staged(df, folder, name) for name, df in hits.items()})
    store.write_partition(merge(before, summary(batch)), root, TABLE, stream, since)
    return found
