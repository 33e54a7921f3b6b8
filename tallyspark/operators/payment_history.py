"""Duplicate payments of a new batch against the payments of all earlier ones, without shuffling these again.

The history is a table of payment cells, bucketed by a key on which pairs can meet: vendor, amount and a span of days. A batch
sends its cells to the three spans around them; the history is read bucket by bucket where it lies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark.functions.skew import SLICE_ROWS, salted_join
from tallyspark.functions.values import day_number, whole_days
from tallyspark.operators import duplicates
from tallyspark.operators.duplicates import CELL_KEYS, PaymentCells
from tallyspark.operators.ledger import narrow, params_with, with_values
from tallyspark.sources.store import file_system

_COLUMNS = "vendor string, amount double, date timestamp_ntz, invoice_key string, n long, cell long, span long, salt int, meet long, batch long"
_SPAN_KEY = ["vendor", "amount", "span"]


def _meet(salt: Column) -> Column:
    """One whole number to bucket and join by: equality of `amount` itself would be on normalised values, which no bucket has."""
    return F.xxhash64(F.col("vendor"), F.col("amount") + F.lit(0.0), F.col("span"), salt.cast("int"))


def _same(a: str, b: str) -> Column:
    """Equality after the join on `meet`; as two comparisons it does not become a join key."""
    return (F.col(a) >= F.col(b)) & (F.col(a) <= F.col(b))


class PaymentHistory:
    """The payments of the batches so far, under `root`. Batches have ascending numbers; one that is added again replaces itself.

    The window of days is part of the stored key and fixed. A vendor, amount and span with more than `tile` cells in a batch is
    dealt out over several buckets; which keys are so, and how far, is stored with the batch that brought them.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 200, params: dict | None = None, tile: int = duplicates.TILE):
        self.spark, self.root, self.tile, self.buckets = spark, root, tile, int(buckets)
        self.window_days = int(params_with(params)["duplicate_payment_window_days"])
        self.table = f"payment_cells_{uuid.uuid4().hex[:12]}"
        path, fs = file_system(spark, f"{root}/cells")
        fs.mkdirs(path)
        location = f"{root}/cells".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.table} ({_COLUMNS}) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (meet) SORTED BY (meet) INTO {self.buckets} BUCKETS LOCATION '{location}'")
        spark.catalog.recoverPartitions(self.table)  # batches of earlier sessions

    def close(self) -> None:
        """Forget the table's name; its files stay, and another PaymentHistory of the same bucket number can take them up."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _write(self, df: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.root}/{name}/batch={number}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _earlier(self, name: str, schema: str, number: int) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{name}").filter(F.col("batch") <= number)

    def _has_earlier(self, number: int) -> bool:
        return any(int(row[0].split("=")[1]) < number for row in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect())  # one row per batch

    def add(self, number: int, ledger: DataFrame) -> PaymentCells:
        """Pairs of cells inside this batch and with all batches of smaller numbers, as `payment_cells` has them for a whole ledger.

        The batch is stored before it is compared, so whatever fails can be repeated. Row numbers have to be unique over all batches.
        """
        batch = narrow(ledger)
        invoice = F.col("invoice_no") if "invoice_no" in batch.columns else F.lit(None)
        named = F.when(invoice.isNull(), "-").otherwise(F.concat(F.lit("#"), invoice))
        payments = with_values(batch, ["vendor", "amount", "date"]).withColumn("invoice_key", named)
        cells = payments.groupBy(*CELL_KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("cell"))
        cells = self._write(cells.withColumn("span", F.floor(day_number(F.col("date")) / (self.window_days + 1))), "batches", number)

        spans = cells.groupBy(*_SPAN_KEY).agg(F.count(F.lit(1)).alias("_n"))
        hot = spans.filter(F.col("_n") > self.tile).select(*_SPAN_KEY, F.ceil(F.col("_n") / self.tile).cast("int").alias("sides"))
        self._write(hot, "hot", number)
        hot = self._earlier("hot", "vendor string, amount double, span long, sides int", number)
        hot = hot.groupBy(*_SPAN_KEY).agg(F.max("sides").alias("sides"))

        salt = F.pmod(F.xxhash64("cell"), F.coalesce("sides", F.lit(1)).cast("bigint")).cast("int")
        stored = cells.join(hot, _SPAN_KEY, "left").withColumn("salt", salt).withColumn("meet", _meet(F.col("salt")))
        names = ", ".join(c.split()[0] for c in _COLUMNS.split(", ")[:-1])
        self.spark.sql(  # one partition is replaced, the others stay; a task for each bucket
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {int(number)}) SELECT {names} FROM {{stored}}",
            stored=stored.repartition(self.buckets, "meet"))

        folded = cells.filter("n > 1").select(*CELL_KEYS, "cell", "n")
        heavy = self._write(folded.filter(F.col("n") > SLICE_ROWS), "heavy", number)  # written, so that joins know its size
        inside = salted_join(payments, folded, CELL_KEYS, heavy, "n", F.col("row_index")).select("cell", "n", "row_index")
        self._write(inside, "members", number)

        pairs = duplicates.cell_pairs(cells, self.window_days, lambda df, name: self._write(df, name, number))
        if self._has_earlier(number):
            pairs = pairs.unionByName(self.pairs_with_history(number, cells, hot))
        pairs = self._write(pairs, "pairs", number)  # `unfolded` reads them several times
        return PaymentCells(pairs, self._earlier("members", "cell long, n long, row_index long", number).drop("batch"), payments)

    def pairs_with_history(self, number: int, cells: DataFrame, hot: DataFrame) -> DataFrame:
        """Pairs of the cells of a batch with those of earlier batches; only the batch is shuffled."""
        near = cells.withColumn("span", F.explode(F.array(*[F.col("span") + i for i in (-1, 0, 1)])))
        near = near.join(hot, _SPAN_KEY, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("sides", F.lit(1)) - 1)))
        near = near.withColumn("meet", _meet(F.col("salt"))).select(
            "meet", *[F.col(c).alias(f"{c}_x") for c in ("vendor", "amount", "span", "date", "invoice_key", "n", "cell")])
        past = self.spark.table(self.table).filter(F.col("batch") < number)
        same = _same("vendor", "vendor_x") & _same("amount", "amount_x") & _same("span", "span_x")
        other = (F.col("invoice_key") < F.col("invoice_key_x")) | (F.col("invoice_key") > F.col("invoice_key_x")) | (F.col("invoice_key") == "-")
        met = past.join(near.hint("merge"), "meet").filter(same & other)
        first = F.struct("date", "cell") <= F.struct(F.col("date_x").alias("date"), F.col("cell_x").alias("cell"))
        take = lambda c, early: F.when(first if early else ~first, F.col(c)).otherwise(F.col(f"{c}_x"))
        ordered = met.select(
            "vendor", "amount", *[take(c, early).alias(f"{c}_{side}") for side, early in (("a", True), ("b", False)) for c in ("cell", "n", "date")])
        days = ordered.withColumn("days_apart", whole_days(F.col("date_a"), F.col("date_b")))
        return days.filter(F.col("days_apart") <= self.window_days).select(*duplicates._PAIR)
