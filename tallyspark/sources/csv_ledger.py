"""Read a delimited ledger with every column as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.names import ROW_INDEX, col, data_columns, distinct_names

# Bytes of a file that one task may read whole.
LARGEST_WHOLE_FILE = 2 << 30

# Rows per numbering chunk in `dense_row_index`.
CHUNK = 1 << 20


class EmptyLedgerError(ValueError):
    """The file has no columns or no rows."""


class MalformedLedgerError(ValueError):
    """Files of one ledger have different columns, or a file cannot be split and is too large to be read whole."""


_RAW = "_malformed_record"  # the text of a row that has not as many cells as the header


def read_csv_ledger(spark: SparkSession, path: str, multi_line: bool | None = None, skip_bad_rows: bool = False) -> DataFrame:
    """All-text ledger with trimmed names, missing-value tokens as NULL and `row_index`.

    A first scan looks at each file's header and at lines with an odd number of quotes. Only files that have such lines can
    hold line breaks inside cells and are read whole, by one task each; above LARGEST_WHOLE_FILE bytes they are refused. The
    others are split. `multi_line` decides for all files instead: True reads files of any size whole.
    Files may have their columns in different order, but must have the same ones.

    A row with more cells than the header, or with bytes that are not UTF-8, stops the read; with `skip_bad_rows` such
    rows are left out, and `rejected_rows` lists them.
    """
    return _read(spark, path, multi_line, refuse=not skip_bad_rows, keep_bad=False)


def rejected_rows(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """The rows that `read_csv_ledger` refuses, with `row_index`, the cells read and the text of rows with too many cells."""
    return _read(spark, path, multi_line, refuse=False, keep_bad=True)


def _read(spark: SparkSession, path: str, multi_line: bool | None, refuse: bool, keep_bad: bool) -> DataFrame:
    parts, names = [], None
    for whole, files in _alike_files(spark, path, multi_line):
        reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", whole)
        header = reader.option("header", False).csv(files).limit(1).collect()
        if not header or not any(header[0]):
            raise EmptyLedgerError("File contains no columns/data")
        own = distinct_names(list(header[0]))
        names = names or own
        if sorted(own) != sorted(names):
            raise MalformedLedgerError(f"Files have different columns: {names} and {own}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*own, _RAW)])
        reader = reader.option("columnNameOfCorruptRecord", _RAW).option("header", True)
        parts.append(reader.schema(schema).csv(files).select(*[col(n) for n in names], _RAW))
    if not parts:
        raise EmptyLedgerError("File contains no columns/data")
    raw = reduce(DataFrame.union, parts)
    if raw.isEmpty():
        raise EmptyLedgerError("File contains no columns/data")
    damaged = reduce(lambda a, b: a | b, [F.coalesce(F.contains(col(n), F.lit("\ufffd")), F.lit(False)) for n in names])
    commas = F.length(F.regexp_replace(F.regexp_replace(_RAW, '"(?:[^"]|"")*"', ""), "[^,]", ""))
    bad = F.coalesce(commas >= len(names), F.lit(False)) | damaged  # shorter rows are filled with NULL
    cells = [F.when(~col(n).isin(fv.CSV_NULL_TOKENS), col(n)).alias(n) for n in names]
    index = F.monotonically_increasing_id()
    if refuse:
        # In a filter, as a column that nobody reads is left out together with its check.
        stop = F.raise_error(F.lit("A row has more cells than the header, or bytes that are not UTF-8")).cast("boolean")
        return raw.filter(F.when(bad, stop).otherwise(True)).select(index.alias(ROW_INDEX), *cells)
    kept = raw.select(index.alias(ROW_INDEX), *cells, _RAW, bad.alias("_bad"))
    return kept.filter("_bad").drop("_bad") if keep_bad else kept.filter("not _bad").drop("_bad", _RAW)


def _alike_files(spark: SparkSession, path: str, multi_line: bool | None) -> list[tuple[bool, list[str]]]:
    """Files by header line and by the need to be read whole; one row per file comes to the driver."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
        F.col("_metadata.file_size").alias("bytes"),
    )
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    files = lines.groupBy("file").agg(F.bool_or(odd).alias("odd"), F.min_by("value", "place").alias("header"), F.max("bytes").alias("bytes"))
    groups: dict[tuple, list[str]] = {}
    for r in sorted(files.collect(), key=lambda r: r["file"]):
        whole = r["odd"] if multi_line is None else multi_line
        if whole and multi_line is None and r["bytes"] > LARGEST_WHOLE_FILE:
            raise MalformedLedgerError(f"{r['file']} has line breaks inside cells and {r['bytes']} bytes; write it in smaller files")
        groups.setdefault((whole, r["header"]), []).append(r["file"])
    return [(whole, found) for (whole, _), found in groups.items()]


def dense_row_index(df: DataFrame) -> DataFrame:
    """Renumber `row_index` to 0, 1, 2, ... in its own order.

    Rows are numbered inside chunks of the old index and shifted by the rows of the
    chunks before. Only the chunk totals (a million rows per chunk) meet in one task.
    """
    chunked = df.withColumn("_chunk", F.shiftright(F.col(ROW_INDEX), CHUNK.bit_length() - 1))
    totals = chunked.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    shifts = totals.select(
        "_chunk", (F.sum("_n").over(W.orderBy("_chunk")) - F.col("_n")).alias("_shift")
    )
    inside = F.row_number().over(W.partitionBy("_chunk").orderBy(ROW_INDEX)) - 1
    return (
        chunked.withColumn("_inside", inside)
        .join(shifts, "_chunk")
        .select((F.col("_shift") + F.col("_inside")).alias(ROW_INDEX), *[col(c) for c in data_columns(df)])
    )
