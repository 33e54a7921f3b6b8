"""Duplicate invoices, duplicate payments and gaps in invoice numbering."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.skew import salted_join
from tallyspark.functions.values import day_number, has_columns, minus, plus, whole_days
from tallyspark.operators.ledger import params_with, snapshot_columns, with_values

INVOICE_KEYS = ["invoice_no", "vendor", "amount", "date"]
# A hot (vendor, amount, bucket) is cut into tiles of at most about TILE x TILE comparisons of cells.
TILE = 4_096
# Cells of several rows are unfolded in tiles of about UNFOLD x UNFOLD pairs of rows.
UNFOLD = 128


def duplicate_invoices(ledger: DataFrame) -> DataFrame:
    """One row per (invoice, vendor, amount, date) posted more than once."""
    return (
        with_values(ledger, INVOICE_KEYS)
        .groupBy(*INVOICE_KEYS)
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter(F.col("duplicate_count") > 1)
        .withColumn("total_exposure", F.col("amount") * (F.col("duplicate_count") - 1))
    )


def duplicate_invoice_rows(ledger: DataFrame) -> DataFrame:
    """The postings behind `duplicate_invoices`."""
    groups = duplicate_invoices(ledger).select(*INVOICE_KEYS, "duplicate_count")
    hits = salted_join(
        with_values(ledger, INVOICE_KEYS), groups.drop("duplicate_count"), INVOICE_KEYS,
        groups, "duplicate_count", F.col("row_index"),
    )
    return hits.select(*snapshot_columns(ledger))


def repeated_payments(ledger: DataFrame) -> DataFrame:
    """Payments whose vendor and amount occur more than once, with their snapshots; no other payment can have a partner.

    In most ledgers this leaves a small share of the rows for all that follows.
    """
    invoice = F.col("invoice_no")
    named = F.when(invoice.isNull(), F.lit("-")).otherwise(F.concat(F.lit("#"), invoice))
    payments = with_values(ledger, ["vendor", "amount", "date"]).select(*snapshot_columns(ledger)).withColumn("invoice_key", named)
    key = ["vendor", "amount"]
    repeated = payments.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return salted_join(payments, repeated, key, repeated, "_n", F.col("row_index")).drop("_n")


CELL_KEYS = ["vendor", "amount", "date", "invoice_key"]


def _cells(payments: DataFrame) -> DataFrame:
    """Payments that agree in vendor, amount, date and invoice are one cell, named by its first row."""
    return payments.groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("row_index").alias("cell")
    )


def _cell_pairs(cells: DataFrame, window_days: int, stage=None) -> DataFrame:
    """Pairs of different cells within the window: equi-join on a date bucket, then the exact test.

    Whole-day distance <= w means less than w+1 days, so the later cell lies in the
    bucket of the earlier one or the next; the earlier side is offered to both.
    """
    bucketed = cells.withColumn("bucket", F.floor(day_number(F.col("date")) / (window_days + 1)))
    key = ["vendor", "amount", "bucket"]
    # Counted through n and cell: all branches then read the same columns and share one shuffle of the cells.
    n_cells = F.count_if((F.col("n") > 0) & F.col("cell").isNotNull())
    grid = (
        bucketed.groupBy(*key).agg(n_cells.alias("_n")).filter(F.col("_n") > TILE)
        .select(*key, F.ceil(F.col("_n") / TILE).cast("int").alias("_side"))
    )
    if stage:  # joins then know that it is small; by its estimate all cells would be shuffled to meet it
        grid = stage(grid, "payment_grid")

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        side = F.coalesce(F.col("_side"), F.lit(1))
        return (
            df.join(grid, key, "left")
            .withColumn(own, F.pmod(F.xxhash64("cell"), side.cast("bigint")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), side - 1)))
            .drop("_side")
        )

    offered = bucketed.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    join_key = [*key, "_i", "_j"]
    # A number of partitions of our own: merging small inputs would fold tiles, whose cost is a square, together again.
    parts = _partitions(cells)
    early = placed(offered, "_i", "_j").select(*join_key, *_suffixed("a")).repartition(parts, *join_key)
    late = placed(bucketed, "_j", "_i").select(*join_key, *_suffixed("b")).repartition(parts, *join_key)
    in_order = (F.col("date_a") < F.col("date_b")) | (
        (F.col("date_a") == F.col("date_b")) & (F.col("cell_a") < F.col("cell_b"))
    )
    other_invoice = (F.col("key_a") != F.col("key_b")) | (F.col("key_a") == "-")
    return (
        early.join(late, join_key)
        .filter(in_order & other_invoice)
        .withColumn("days_apart", whole_days(F.col("date_a"), F.col("date_b")))
        .filter(F.col("days_apart") <= window_days)
        .select(*_PAIR)
    )


def cell_pairs(cells: DataFrame, window_days: int, stage=None) -> DataFrame:
    """Pairs of cells within the window, and cells of several payments without an invoice with themselves."""
    own = cells.filter((F.col("n") > 1) & (F.col("invoice_key") == "-")).select(
        "vendor", "amount", F.col("cell").alias("cell_a"), F.col("n").alias("n_a"), F.col("date").alias("date_a"),
        F.col("cell").alias("cell_b"), F.col("n").alias("n_b"), F.col("date").alias("date_b"),
        F.lit(0).alias("days_apart"),
    )
    return _cell_pairs(cells, window_days, stage).unionByName(own)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_PAIR = ["vendor", "amount", "cell_a", "n_a", "date_a", "cell_b", "n_b", "date_b", "days_apart"]


def _suffixed(side: str) -> list[Column]:
    return [
        F.col("cell").alias(f"cell_{side}"), F.col("n").alias(f"n_{side}"),
        F.col("date").alias(f"date_{side}"), F.col("invoice_key").alias(f"key_{side}"),
    ]


class PaymentCells(NamedTuple):
    """Duplicate payments as pairs of cells: what a run stores. `unfolded` gives the pairs of rows."""

    pairs: DataFrame  # cell_a, n_a, date_a, cell_b, n_b, date_b, vendor, amount, days_apart
    members: DataFrame  # cell, n, row_index of every row of a cell in `pairs`
    payments: DataFrame  # the repeated payments with their snapshots


def payment_cells(ledger: DataFrame, params: dict | None = None, stage=None) -> PaymentCells:
    """Pairs of cells within the window, unless both carry the same invoice.

    Equal payments are folded into cells first, so copies of one invoice are never compared with each other.
    `stage(df, name)`, if given, writes the repeated payments, the pairs and the members once for all later steps.
    """
    window_days = int(params_with(params)["duplicate_payment_window_days"])
    stage = stage or (lambda df, name: df)
    payments = stage(repeated_payments(ledger), "repeated_payments")
    cells = _cells(payments)
    pairs = stage(cell_pairs(cells, window_days), "payment_pairs")
    folded = cells.filter((F.col("n") > 1) & F.col("cell").isNotNull())
    inside = salted_join(payments, folded.select(*CELL_KEYS, "cell"), CELL_KEYS, folded, "n", F.col("row_index"))
    sizes = folded.select("cell", "n")
    members = inside.select("cell", "row_index").join(sizes, "cell")
    return PaymentCells(pairs, stage(members, "payment_members"), payments)


def unfolded(found: PaymentCells) -> DataFrame:
    """Every pair of rows behind the pairs of cells.

    Rows of a larger cell are dealt to slices of about UNFOLD, and a pair of cells becomes a tile per pair of slices. Rows
    are offered to the tiles of their slice and meet by an equi-join on the tile, spread evenly over all partitions,
    so a single hot cell is neither gathered nor unfolded in one task.
    """
    pairs, parts = found.pairs, _partitions(found.pairs)
    plain = pairs.filter((F.col("n_a") == 1) & (F.col("n_b") == 1)).select(
        "*", F.col("cell_a").alias("row_a"), F.col("cell_b").alias("row_b")
    )
    slices = lambda n: F.ceil(F.col(n) / UNFOLD).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), slices(n) - 1))
    tiles = pairs.filter((F.col("n_a") > 1) | (F.col("n_b") > 1)).withColumn("slice_a", span("n_a")).withColumn("slice_b", span("n_b"))
    tiles = tiles.filter((F.col("cell_a") != F.col("cell_b")) | (F.col("slice_a") <= F.col("slice_b")))
    sliced = found.members.withColumn("slice", F.pmod(F.xxhash64("row_index"), slices("n").cast("bigint")).cast("int"))
    tile = ["cell_a", "cell_b", "slice_a", "slice_b"]

    def offered(side: str) -> DataFrame:
        cell, n, row = f"cell_{side}", f"n_{side}", f"row_{side}"
        alone = tiles.filter(F.col(n) == 1).withColumn(row, F.col(cell))
        own = sliced.select(F.col("cell").alias(cell), F.col("slice").alias(f"slice_{side}"), F.col("row_index").alias(row))
        several = tiles.filter(F.col(n) > 1).join(own, [cell, f"slice_{side}"])
        return alone.unionByName(several)

    left = offered("a").repartition(parts, *tile)
    right = offered("b").select(*tile, "row_b").repartition(parts, *tile)
    several = left.join(right, tile).filter(
        (F.col("cell_a") != F.col("cell_b")) | (F.col("slice_a") != F.col("slice_b")) | (F.col("row_a") < F.col("row_b"))
    )
    rows = plain.unionByName(several.select(*plain.columns))
    swap = (F.col("date_a") == F.col("date_b")) & (F.col("row_a") > F.col("row_b"))
    return rows.select(
        "vendor", "amount", "days_apart", "date_a", "date_b",
        F.when(swap, F.col("row_b")).otherwise(F.col("row_a")).alias("row_a"),
        F.when(swap, F.col("row_a")).otherwise(F.col("row_b")).alias("row_b"),
    )


def duplicate_payments(ledger: DataFrame, params: dict | None = None, stage=None) -> DataFrame:
    """Every pair of payments of one vendor and amount within the window, unless both carry the same invoice."""
    return unfolded(payment_cells(ledger, params, stage))


def duplicate_payment_rows(found: PaymentCells) -> DataFrame:
    """Both rows of each pair, with their snapshots from the repeated payments (a row may sit in many pairs)."""
    sides = unfolded(found).select("row_a", "row_b", F.explode(F.array("row_a", "row_b")).alias("row_index"))
    return sides.join(found.payments.drop("invoice_key"), "row_index")


def invoice_numbers(ledger: DataFrame) -> DataFrame:
    """Distinct first digit runs of invoice_no, of any length, as text without leading zeros."""
    if not has_columns(ledger, ["invoice_no"]):
        return ledger.sparkSession.createDataFrame([], "number string")
    digits = F.regexp_extract("invoice_no", r"\d+", 0)
    number = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    return ledger.select(F.when(digits != "", number).alias("number")).filter(F.col("number").isNotNull()).distinct()


def _by_value(number: str) -> Column:
    """Orders whole numbers in text by value."""
    return F.struct(F.length(number).alias("digits"), F.col(number).alias("number"))


def sequential_gap(ledger: DataFrame) -> DataFrame:
    """At most one row: the span of invoice numbers and the share that is missing. Whole numbers are text of any length."""
    c = F.col

    def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
        """A column that later ones use; as a generated row, so that its long expression is not copied into theirs."""
        return df.select("*", F.explode(F.array(value)).alias(name))

    spans = (
        invoice_numbers(ledger)
        .agg(
            F.min(_by_value("number"))["number"].alias("first_number"),
            F.max(_by_value("number"))["number"].alias("last_number"),
            F.count("number").alias("actual_count"),
        )
    )
    spans = computed(spans, "_distance", minus(c("last_number"), c("first_number")))
    spans = computed(spans, "expected_count", plus(c("_distance"), F.lit("1")))
    spans = computed(spans, "missing_count", minus(c("expected_count"), c("actual_count").cast("string")))
    return (
        spans.drop("_distance")
        .withColumn("gap_pct", F.try_divide(c("missing_count").cast("double"), c("expected_count").cast("double")) * 100)
        .filter((c("actual_count") >= fv.SEQUENCE_MIN_NUMBERS) & (c("gap_pct") > fv.SEQUENCE_GAP_PCT))
    )


def missing_numbers(ledger: DataFrame) -> DataFrame:
    """The first missing invoice numbers, smallest first, as text.

    Every number marks its neighbours; an unmarked neighbour is the edge of a hole.
    The i-th smallest lower edge belongs to the i-th smallest upper edge, and each
    hole holds at least one number, so the first 25 holes are enough.
    """
    size = fv.SEQUENCE_SAMPLE
    numbers = invoice_numbers(ledger)
    n = F.col("number")

    present, opens, closes = 1, 2, 4

    def mark(value: Column, flag: int) -> Column:
        return F.struct(value.alias("number"), F.lit(flag).alias("flag"))

    below = F.when(n != "0", minus(n, F.lit("1")))
    edges = (
        numbers.select(F.explode(F.array(mark(n, present), mark(plus(n, F.lit("1")), opens), mark(below, closes))).alias("m"))
        .filter("m.number is not null")
        .groupBy("m.number").agg(F.bit_or("m.flag").alias("flags"))
        .filter(F.col("flags").bitwiseAND(present) == 0)
    )
    bounds = sequential_gap(ledger).select(
        F.struct(_by_value("first_number").alias("first"), _by_value("last_number").alias("last"))
    ).scalar()

    def first_edges(flag: int, name: str) -> DataFrame:
        inner = edges.filter(
            (F.col("flags").bitwiseAND(flag) > 0)
            & (_by_value("number") > bounds["first"]) & (_by_value("number") < bounds["last"])
        )
        smallest = inner.orderBy(F.length("number"), "number").limit(size).agg(
            F.sort_array(F.collect_list(_by_value("number"))).alias("_all")
        )
        return smallest.select(F.posexplode("_all.number").alias("hole", name))

    return (
        first_edges(opens, "start").join(first_edges(closes, "end"), "hole")
        .select("end", "start", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_step"))
        .select(plus(F.col("start"), F.col("_step").cast("string")).alias("missing_number"), "end")
        .filter(_by_value("missing_number") <= _by_value("end"))
        .orderBy(F.length("missing_number"), "missing_number").limit(size)
        .select("missing_number")
    )
