"""Map source columns onto canonical roles, for one ledger or a table of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as fv
from tallyspark.functions.names import col, data_columns
from tallyspark.functions.values import column_kind, strip_text


def role_candidates(columns: DataFrame) -> DataFrame:
    """Score every (dataset, column, role) whose name contains a keyword of the role.

    `columns` holds dataset_id, column, ordinal and type. Only the first matching
    keyword of a role counts: 100 less the difference in length, 50 more if equal.
    The keywords are constants of one projection, so nothing is joined or shuffled.
    """
    name = F.col("_name")

    def candidate(order: int, role: str) -> Column:
        word = F.coalesce(*[F.when(F.contains(name, F.lit(w)), w) for w in fv.ROLE_KEYWORDS[role]])
        score = 100 - F.abs(F.length(name) - F.length(word)) + F.when(name == word, 50).otherwise(0)
        needs = fv.ROLE_TYPES[role]
        fits = word.isNotNull() if needs is None else word.isNotNull() & (F.col("type") == needs)
        return F.when(fits, F.struct(
            F.lit(role).alias("role"), F.lit(order).alias("role_order"), word.alias("keyword"), score.alias("score")
        ))

    found = F.array_compact(F.array(*[candidate(i, role) for i, role in enumerate(fv.ROLE_KEYWORDS)]))
    return (
        columns.withColumn("_name", F.replace(F.lower(strip_text(F.col("column"))), F.lit(" "), F.lit("_")))
        .select("dataset_id", "column", "ordinal", F.explode(found).alias("_c"))
        .select("dataset_id", "_c.role", "_c.role_order", "column", "ordinal", "_c.keyword", "_c.score")
    )


def assign_roles(candidates: DataFrame) -> DataFrame:
    """Greedy assignment per dataset: best score first, then role order, then column order.

    The candidates of a dataset (at most six per column) are folded in one expression.
    """
    ranked = F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("rank"), "role_order", "ordinal", "role", "column", "score"
    )))
    item = "struct<rank: int, role_order: int, ordinal: bigint, role: string, column: string, score: int>"

    def step(taken: Column, c: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["role"] == c["role"]) | (t["column"] == c["column"]))
        return F.when(free, F.concat(taken, F.array(c))).otherwise(taken)

    picked = F.aggregate(F.col("_ranked").cast(f"array<{item}>"), F.array().cast(f"array<{item}>"), step)
    return (
        candidates.groupBy("dataset_id").agg(ranked.alias("_ranked"))
        .select("dataset_id", F.explode(picked).alias("_p"))
        .select("dataset_id", F.col("_p.role").alias("role"), F.col("_p.column").alias("column"),
                F.col("_p.score").alias("score"))
    )


def column_table(df: DataFrame, dataset_id: str) -> DataFrame:
    """The schema of a ledger as rows for `role_candidates`."""
    rows = [(dataset_id, c, i, column_kind(df, c)) for i, c in enumerate(data_columns(df))]
    return df.sparkSession.createDataFrame(rows, "dataset_id string, column string, ordinal bigint, type string")


def infer_mapping(df: DataFrame, dataset_id: str = "ledger") -> dict[str, str]:
    """role -> source column for one ledger (at most six rows reach the driver)."""
    found = assign_roles(role_candidates(column_table(df, dataset_id))).collect()
    by_role = {r["role"]: r["column"] for r in found}
    return {role: by_role[role] for role in fv.ROLE_TYPES if role in by_role}


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Add a column per mapped role unless a column of exactly that name exists.

    Spark ignores case in names: a source that differs from the role only by case is
    renamed to the role, and any other such column gets the suffix `_source`.
    """
    names = {c: c for c in df.columns}
    extra = []
    for role, source in mapping.items():
        if source not in df.columns or role in df.columns:
            continue
        twins = [c for c in df.columns if c.lower() == role]
        if source in twins:
            names[source] = role
            continue
        for twin in twins:
            names[twin] = f"{twin}_source"
        extra.append(col(source).alias(role))
    return df.select(*[col(c).alias(n) for c, n in names.items()], *extra)


def quality_gate(datasets: DataFrame) -> DataFrame:
    """(dataset_id, error): why a dataset may not be audited; NULL where it may.

    `datasets` holds dataset_id, row_count, column_count and role_count.
    """
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("row_count") < fv.GATE_MIN_ROWS, fv.GATE_FEW_ROWS),
        F.when(F.col("column_count") == 0, fv.GATE_NO_COLUMNS),
        F.when(F.col("role_count") == 0, fv.GATE_NO_ROLES),
    )
    return datasets.select("dataset_id", F.nullif(reasons, F.lit("")).alias("error"))
