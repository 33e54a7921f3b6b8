"""The narrow ledger every rule reads: `row_index` plus the mapped roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.values import display_text, is_numeric, is_time

ROLE_SQL_TYPES = {
    "invoice_no": "string",
    "vendor": "string",
    "amount": "double",
    "date": "timestamp_ntz",
    "entry_date": "timestamp_ntz",
    "timestamp": "timestamp_ntz",
}


def params_with(overrides: dict | None) -> dict:
    """Defaults with overrides; a falsy materiality threshold falls back to the default."""
    params = {**fv.DEFAULT_PARAMS, **(overrides or {})}
    if not params["materiality_threshold"]:
        params["materiality_threshold"] = fv.DEFAULT_PARAMS["materiality_threshold"]
    return params


def narrow(df: DataFrame) -> DataFrame:
    """Project to row_index and the usable roles, with their canonical types.

    A role whose column has the wrong type is left out, so rules that need it yield nothing.
    """
    def usable(role: str) -> bool:
        if role == "invoice_no":
            return True
        if role == "vendor":
            return not is_time(df, role)
        return is_numeric(df, role) if role == "amount" else is_time(df, role)

    def typed(role: str) -> Column:
        if role == "invoice_no":
            return display_text(df, role).alias(role)
        return F.col(role).cast(ROLE_SQL_TYPES[role]).alias(role)

    roles = [r for r in ROLE_SQL_TYPES if r in df.columns and usable(r)]
    return df.select(F.col("row_index").cast("bigint").alias("row_index"), *[typed(r) for r in roles])


def snapshot_columns(df: DataFrame) -> list[Column]:
    """row_index and all six roles; unmapped ones are NULL."""
    return [F.col("row_index")] + [
        (F.col(role) if role in df.columns else F.lit(None)).cast(kind).alias(role)
        for role, kind in ROLE_SQL_TYPES.items()
    ]


def with_values(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows where all the named columns are present."""
    for name in names:
        df = df.filter(F.col(name).isNotNull())
    return df
