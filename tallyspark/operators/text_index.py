"""Substring search over stored findings by postings: which parts of the table hold the trigrams of a needle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GRAM = 3


def _grams(name: str) -> Column:
    """Distinct trigrams of the lower-case text; none in a NULL or shorter one."""
    low = F.lower(F.col(name))
    places = F.sequence(F.lit(1), F.length(low) - GRAM + 1)
    found = F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))
    return F.when(F.length(low) >= GRAM, found).otherwise(F.array().cast("array<string>"))


def write_index(rows: DataFrame, folder: str, columns: list[str], order: list[str], parts: int) -> None:
    """Write the rows in `parts` ranges of `order` and, for every trigram in `columns`, the parts that hold it.

    Columns named `part` give way. Choose an order that keeps similar texts together: it decides how few parts a search
    reads, never what it finds. Postings are sorted by trigram, so a search reads few of their row groups too.
    """
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed.write.partitionBy("part").parquet(f"{folder}/rows")
    stored = rows.sparkSession.read.parquet(f"{folder}/rows")
    grams = stored.select("part", F.explode(F.array_distinct(F.concat(*[_grams(c) for c in columns]))).alias("gram"))
    grams.distinct().repartitionByRange("gram").sortWithinPartitions("gram", "part").write.parquet(f"{folder}/postings")


def parts_with(spark: SparkSession, folder: str, needle: str) -> list[int] | None:
    """The parts that hold all trigrams of the needle; None, all of them, if it is too short to have one."""
    low = needle.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return None
    postings = spark.read.schema("part int, gram string").parquet(f"{folder}/postings").filter(F.col("gram").isin(wanted))
    met = postings.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
    return sorted(r["part"] for r in met.collect())  # no more than the table has parts


def search_index(spark: SparkSession, folder: str, columns: list[str], needle: str) -> DataFrame:
    """The rows in which a column holds the needle, whatever its case; only files of parts that can have one are read."""
    rows, parts = spark.read.parquet(f"{folder}/rows"), parts_with(spark, folder, needle)
    if parts is not None:
        rows = rows.filter(F.col("part").isin(parts) if parts else F.lit(False))
    holds = [F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False)) for c in columns]
    return rows.filter(reduce(lambda a, b: a | b, holds)).drop("part")
