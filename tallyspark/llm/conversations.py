"""What the operators on conversations share: places of turns, and streams of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.sources import store

#: Low bits of monotonically_increasing_id: the place in its partition.
PLACE_BITS = 33


def written_in_order(rows: DataFrame, folder: str, order: Sequence[Column]) -> DataFrame:
    """The rows as a written table in this order, with their place: `_part` and, ascending in it, `_at`.

    Ranges are cut wherever they fill, also inside one conversation. Rows that tie in `order` are parted by their place
    in the input; they may come in any order.
    """
    tie = F.monotonically_increasing_id()
    sorted_rows = rows.withColumn("_tie", tie).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    placed = store.staged(sorted_rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), folder, "ordered")
    return placed.withColumn("_part", F.shiftright("_at", PLACE_BITS))


def with_positions(ordered: DataFrame, columns: Sequence[str], key: str, last: Column | None = None) -> DataFrame:
    """`columns` of a table from `written_in_order`, with pos (from 0) and size of the key's rows.

    Its order has to begin with `key` (never NULL). Windows see one row for each key and partition only. With `last`, a column
    before_part holds its value at the last row of the key in the partitions before this one.
    """
    ends = [F.max_by(last, "_at").alias("_last")] if last is not None else []
    runs = ordered.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *ends)
    parts = W.partitionBy(key).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    size = F.sum("_n").over(W.partitionBy(key)).alias("size")
    more = [F.lag("_last").over(parts).alias("before_part")] if last is not None else []
    runs = runs.select(key, "_part", "_first", before, size, *more)
    pos = (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos")
    return ordered.select(*columns, "_at", "_part").join(runs, [key, "_part"]).select(
        *columns, "_at", "_part", "_first", pos, "size", *(["before_part"] if last is not None else []))


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of sorted batches, one after another."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def runs_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that agree in the first `n_keys` columns; batches have to be sorted by them."""
    return groupby(streamed(batches), key=lambda r: r[:n_keys])


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, with no more than `most` held at a time."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
