"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A key above SLICE_ROWS rows is cut into slices of about that many.
SLICE_ROWS = 1_000_000


def heavy_keys(sizes: DataFrame, keys: Sequence[str], size: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All keys of more than `slice_rows` rows and the number of slices each is cut into.

    At most one key per `slice_rows` rows. Whether the table is broadcast is left to Spark's own size check.
    """
    return sizes.filter(F.col(size) > slice_rows).select(*keys, F.ceil(F.col(size) / slice_rows).cast("int").alias("_slices"))


def salted_join(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    sizes: DataFrame,
    size: str,
    row_id: Column,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Inner join of many `rows` to few `groups` on `keys`.

    `sizes` holds one row per key with the number of `rows` under it. Rows of a
    heavy key are spread over slices and only the matching group rows are copied
    to each slice, so the copies number at most `rows / slice_rows`.
    """
    salted_rows, salted_groups = _salted(rows, groups, list(keys), sizes, size, row_id, slice_rows)
    return salted_rows.join(salted_groups, [*keys, "_salt"]).drop("_salt")


def _salted(rows, groups, keys, sizes, size, row_id, slice_rows) -> tuple[DataFrame, DataFrame]:
    heavy = heavy_keys(sizes, keys, size, slice_rows)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    salted_rows = (
        rows.join(heavy, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(row_id), slices.cast("bigint")).cast("int"))
        .drop("_slices")
    )
    salted_groups = (
        groups.join(heavy, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return salted_rows, salted_groups
