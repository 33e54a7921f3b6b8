"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyspark.sources import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words as the contracts define them: runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only; `lower` would change other letters too."""
    return F.translate(c, UPPER, LOWER)


def reachable_by_workers(spark: SparkSession) -> None:
    """Let Python workers import this library when it is not installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    reachable_by_workers(spark)
    return store.scratch_folder(spark)


def pieces(batch: pa.RecordBatch, text_at: int, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most_bytes` of text each (one row at least), so that memory follows that size."""
    start = size = 0
    lengths = pc.binary_length(batch.column(text_at)).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def release_memory() -> None:
    """Hand back what Arrow's pool and the C library keep of freed memory; the worker stays for later stages, which may need little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # C libraries other than glibc
        ctypes.CDLL(None).malloc_trim(0)


def running_totals(df: DataFrame, folder: str, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in `sums`, the total of its column over all rows up to and including this one.

    Rows are range-partitioned and written once; one small row per partition carries the totals of those
    before it, so no window spans more than one partition. `order` must be total for a defined result.
    """
    parts = store.staged(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), folder, "ranges"
    )
    named = {f"_total_{k}": F.sum(c) for k, c in sums.items()}
    totals = parts.groupBy("_part").agg(*[c.alias(k) for k, c in named.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(  # one row per partition of the step above
        "_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in named]
    )
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = parts.join(F.broadcast(offsets), "_part")
    return joined.withColumns(
        {k: F.col(f"_total_{k}") + F.sum(c).over(within) for k, c in sums.items()}
    ).drop("_part", *named)
