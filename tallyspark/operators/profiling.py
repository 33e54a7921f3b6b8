"""Column and dataset profiles of a cleaned ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.names import ROW_INDEX, col, data_columns
from tallyspark.functions.quantiles import exact_percentiles, melt
from tallyspark.functions.values import column_kind, display_text, lookup


def _of_kind(df: DataFrame, kind: str) -> list[str]:
    return [c for c in data_columns(df) if column_kind(df, c) == kind]


def _identity_text(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly where the values are equal."""
    c = col(name)
    if column_kind(df, name) == "numeric":
        c = F.when(c == 0, F.lit(0).cast(df.schema[name].dataType)).otherwise(c)
    return c.cast("string")


def _long_text(df: DataFrame) -> DataFrame:
    columns = data_columns(df)
    return melt(df.select(*[_identity_text(df, c).alias(c) for c in columns]), columns)


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, nulls and distinct values of each column.

    Cells are counted per column and value, so repeated values collapse before the
    shuffle. `approx=True` replaces the exact distinct count by a sketch, which needs
    no shuffle of the values.
    """
    kinds = {c: column_kind(df, c) for c in data_columns(df)}
    position = {c: i for i, c in enumerate(data_columns(df))}
    cells = _long_text(df)
    if approx:
        per_column = cells.groupBy("column").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"),
            F.approx_count_distinct("value").alias("unique_count"),
        )
    else:
        per_column = (
            cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy("column").agg(
                F.sum("_n").alias("row_count"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("null_count"),
                F.count("value").alias("unique_count"),
            )
        )
    return per_column.select(
        lookup(position, F.col("column"), F.lit(None)).alias("ordinal"),
        "column", lookup(kinds, F.col("column"), F.lit(None)).alias("type"), "row_count", "null_count",
        F.round(F.col("null_count") / F.col("row_count") * 100, 2).alias("null_pct"), "unique_count",
    )


def profile_samples(df: DataFrame, n: int = fv.PROFILE_SAMPLES) -> DataFrame:
    """The first non-null values of each column, as text. Per column a heap of `n` rows; two columns are read for it."""
    parts = []
    for c in data_columns(df):
        first = df.filter(col(c).isNotNull()).select(ROW_INDEX, display_text(df, c).alias("value")).orderBy(ROW_INDEX).limit(n)
        placed = first.agg(F.sort_array(F.collect_list(F.struct(ROW_INDEX, "value"))).alias("_first"))
        parts.append(placed.select(F.lit(c).alias("column"), F.posexplode("_first.value").alias("position", "value")))
    stacked = reduce(DataFrame.union, parts)
    return stacked.select("column", (F.col("position") + 1).alias("position"), "value")


def profile_numeric(df: DataFrame) -> DataFrame:
    """mean, median, std, min, max of the numeric columns with values."""
    columns = _of_kind(df, "numeric")
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, mean double, median double, std double, min double, max double"
        )
    long = melt(df.select(*[col(c).cast("double").alias(c) for c in columns]), columns)
    basics = long.filter(F.col("value").isNotNull()).groupBy("column").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    medians = exact_percentiles(long, {"median": 0.5})
    return basics.join(medians, "column").select("column", "mean", "median", "std", "min", "max")


def profile_dates(df: DataFrame) -> DataFrame:
    """First and last value of the date columns with values."""
    columns = _of_kind(df, "date")
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, min_date timestamp_ntz, max_date timestamp_ntz")
    spans = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.min(col(c)).cast("timestamp_ntz").alias("min_date"),
                 F.max(col(c)).cast("timestamp_ntz").alias("max_date"))
        for c in columns
    ]).alias("_spans"))
    return spans.select(F.inline("_spans")).filter(F.col("min_date").isNotNull())


def profile_dataset(columns: DataFrame) -> DataFrame:
    """Row count, column count and completeness from the column profile."""
    cells = F.sum("row_count")
    return columns.agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        F.coalesce(F.round(100 - F.try_divide(F.sum("null_count"), cells) * 100, 2), F.lit(0.0)).alias("completeness_pct"),
    )


def quality_summary(columns: DataFrame) -> DataFrame:
    """Total nulls, columns with nulls and the highest null rate."""
    return columns.agg(
        F.sum("null_count").alias("total_nulls"), F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
        F.max("null_pct").alias("highest_null_pct"),
    )


def column_top_values(df: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The most frequent values of a column and the number of distinct ones."""
    counts = df.filter(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    distinct = counts.agg(F.count_if((F.col("n") > 0) & F.col("value").isNotNull())).scalar()  # same columns, same shuffle
    return counts.orderBy(F.desc("n"), "value").limit(n).select("value", "n", distinct.alias("unique_count"))


def column_stats(df: DataFrame, name: str) -> DataFrame:
    """mean, median, std, min, max, quartiles and IQR outliers of a numeric column."""
    long = melt(df.select(col(name).cast("double").alias(name)), [name])
    parts = exact_percentiles(long, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    basics = long.filter(F.col("value").isNotNull()).groupBy("column").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    reach = (F.col("q3") - F.col("q1")) * fv.IQR_FENCE
    outside = F.count_if((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach))
    outliers = (
        long.join(F.broadcast(parts), "column")  # one row per column
        .groupBy("column", "q1", "median", "q3").agg(outside.alias("outlier_count"))
    )
    return basics.join(outliers, "column").select(
        "column", "mean", "median", "std", "min", "max", "q1", "q3", "outlier_count"
    )


def schema_digest(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """One line per column: `- name (type), examples: ['a', 'b', 'c']`."""
    examples = (
        samples.filter(F.col("position") <= 3)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("_s"))
    )
    listed = F.concat(
        F.lit("["), F.concat_ws(", ", F.transform("_s", lambda s: F.concat(F.lit("'"), s["value"], F.lit("'")))), F.lit("]")
    )
    return columns.join(examples, "column", "left").select(
        "ordinal", "column",
        F.concat(
            F.lit("- "), F.col("column"), F.lit(" ("), F.col("type"), F.lit("), examples: "),
            F.coalesce(listed, F.lit("[]")),
        ).alias("line"),
    )
