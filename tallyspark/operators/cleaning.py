"""Clean an all-text ledger: white space, formula guard, null tokens, copies, types."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.names import ROW_INDEX, col, data_columns, text_columns
from tallyspark.functions.values import (
    guard_formula, is_null_token, looks_date, looks_numeric, parse_date, parse_number, strip_text,
)


def _map_text(df: DataFrame, change) -> DataFrame:
    texts = set(text_columns(df))
    return df.select(*[change(col(c)).alias(c) if c in texts else col(c) for c in df.columns])


def strip_cells(df: DataFrame) -> DataFrame:
    return _map_text(df, strip_text)


def guard_cells(df: DataFrame, compat: bool = True) -> DataFrame:
    """Quote formula-like cells.

    compat=True quotes every cell that starts with = + - @, also negative numbers
    and dashes. compat=False leaves numbers and null tokens alone.
    """
    def change(c: Column) -> Column:
        return guard_formula(c) if compat else F.when(looks_numeric(c) | is_null_token(c), c).otherwise(guard_formula(c))

    return _map_text(df, change)


def null_cells(df: DataFrame) -> DataFrame:
    return _map_text(df, lambda c: F.when(~is_null_token(c), c))


def null_token_count(df: DataFrame) -> Column:
    """Aggregate: cells that hold a null token, over all text columns."""
    counts = [F.count_if(is_null_token(col(c))) for c in text_columns(df)]
    return reduce(lambda a, b: a + b, counts, F.lit(0).cast("bigint"))


def drop_copies(df: DataFrame) -> DataFrame:
    """Keep the first row of each set of equal rows; NULL equals NULL.

    An aggregate, so copies collapse before the shuffle however many there are.
    """
    columns = data_columns(df)
    return df.groupBy(*[col(c) for c in columns]).agg(F.min(ROW_INDEX).alias(ROW_INDEX)).select(
        ROW_INDEX, *[col(c) for c in columns]
    )


def type_votes(df: DataFrame) -> DataFrame:
    """(ordinal, column, non_null, numeric_share, date_share) for the text columns, from one aggregate."""
    votes = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.count(col(c)).alias("non_null"),
            F.avg(F.when(col(c).isNotNull(), looks_numeric(col(c)).cast("double"))).alias("numeric_share"),
            F.avg(F.when(col(c).isNotNull(), looks_date(col(c)).cast("double"))).alias("date_share"),
        )
        for i, c in enumerate(data_columns(df))
        if c in text_columns(df)
    ]
    return df.agg(F.array(*votes).alias("_votes")).select(F.inline("_votes"))


def voted_type() -> Column:
    """numeric before date, each from 80 % of the non-null cells on; text otherwise."""
    return (
        F.when(F.col("numeric_share") >= fv.TYPE_VOTE_SHARE, "numeric")
        .when(F.col("date_share") >= fv.TYPE_VOTE_SHARE, "date")
        .otherwise("text")
    )


def detect_types(df: DataFrame) -> DataFrame:
    return type_votes(df).withColumn("type", voted_type())


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Parse the columns voted numeric or date; cells that do not parse become NULL."""
    parse = {"numeric": parse_number, "date": parse_date}
    return df.select(*[
        parse[types[c]](col(c)).alias(c) if types.get(c) in parse else col(c) for c in df.columns
    ])


def log_table(totals: DataFrame, types: DataFrame) -> DataFrame:
    """(seq, step, column, count) from row totals and type votes.

    `totals` is one row of null_cells, rows_before and rows_after.
    """
    def entry(seq: int, step: str, count: Column) -> Column:
        return F.struct(
            F.lit(seq).alias("seq"), F.lit(step).alias("step"), F.lit(None).cast("string").alias("column"),
            count.cast("bigint").alias("count"),
        )

    steps = F.array(
        entry(0, "normalize_nulls", F.col("null_cells")),
        entry(1, "drop_duplicate_rows", F.col("rows_before") - F.col("rows_after")),
    )
    counts = totals.select(F.explode(steps).alias("_e")).select("_e.*").filter(F.col("count") > 0)
    coerced = types.filter(F.col("type") != "text").select(
        (F.col("ordinal") + 2).alias("seq"), F.concat(F.lit("coerce_"), F.col("type")).alias("step"),
        "column", F.lit(None).cast("bigint").alias("count"),
    )
    return counts.unionByName(coerced)


def cleaning_log(raw: DataFrame, compat: bool = True) -> DataFrame:
    """The cleaning log of a raw ledger as one lazy table."""
    guarded = guard_cells(strip_cells(raw), compat)
    distinct = drop_copies(null_cells(guarded))
    totals = guarded.agg(null_token_count(guarded).alias("null_cells"), F.count(F.lit(1)).alias("rows_before"))
    after = distinct.agg(F.count(F.lit(1))).scalar()
    return log_table(totals.withColumn("rows_after", after), detect_types(distinct))


@dataclass
class Cleaned:
    ledger: DataFrame
    log: DataFrame
    types: dict[str, str]


def clean(raw: DataFrame, stage, compat: bool = True) -> Cleaned:
    """Clean a raw ledger. `stage(df, name)` writes an intermediate table and reads it back.

    The distinct text rows are written once because the type votes must be known
    before the typed columns can be declared; the votes (one row per column) are the
    only data that reaches the driver.
    """
    guarded = guard_cells(strip_cells(raw), compat)
    distinct = stage(drop_copies(null_cells(guarded)), "distinct_text")
    votes = detect_types(distinct).collect()
    types = {v["column"]: v["type"] for v in votes}
    spark = raw.sparkSession
    verdicts = spark.createDataFrame(
        [(v["ordinal"], v["column"], v["type"]) for v in votes], "ordinal int, column string, type string"
    )
    totals = guarded.agg(null_token_count(guarded).alias("null_cells"), F.count(F.lit(1)).alias("rows_before"))
    after = distinct.agg(F.count(F.lit(1))).scalar()
    return Cleaned(coerce(distinct, types), log_table(totals.withColumn("rows_after", after), verdicts), types)
