"""Column names that may hold dots, blanks or quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ROW_INDEX = "row_index"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row index."""
    return [c for c in df.columns if c != ROW_INDEX]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != ROW_INDEX]


def distinct_names(names: list[str | None]) -> list[str]:
    """Trimmed header names; repeated ones (ignoring case) get a number, empty ones their position."""
    seen: set[str] = set()
    out = []
    for i, raw in enumerate(names):
        base = (raw or "").strip() or f"Unnamed: {i}"
        name, n = base, 0
        while name.lower() in seen:
            n += 1
            name = f"{base}.{n}"
        seen.add(name.lower())
        out.append(name)
    return out
