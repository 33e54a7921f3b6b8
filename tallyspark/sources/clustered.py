"""Large ledgers laid out for lookups: clustered by one column, Bloom filters on others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows in a file at most, so that a hot key fills several files instead of one.
FILE_ROWS = 20_000_000


def write_clustered(df: DataFrame, folder: str, by: str, bloom: list[str] | None = None, distinct: int = 1_000_000,
                    row_group_bytes: int = 32 << 20) -> None:
    """Range-partition by a column and sort, so that the bounds of files and row groups tell where a value is.

    Columns in `bloom`, which may lie in any order, get Bloom filters for `distinct` values a row group: a lookup skips the row
    groups that cannot have its value. A hot value is spread over ranges by a hash of its rows.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    writer = df.withColumn("_spread", spread).repartitionByRange(by, "_spread").sortWithinPartitions(by).drop("_spread").write
    writer = writer.option("parquet.block.size", row_group_bytes).option("maxRecordsPerFile", FILE_ROWS)
    for name in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", distinct)
    writer.parquet(folder)


def lookup(spark: SparkSession, folder: str, name: str, value) -> DataFrame:
    """The rows with this value; files and row groups without it are skipped by their bounds, dictionaries and Bloom filters."""
    return spark.read.parquet(folder).filter(F.col(name) == F.lit(value))
