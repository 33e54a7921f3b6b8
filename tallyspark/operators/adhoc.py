"""Guarded read-only SQL over one ledger, registered as `dataset`."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.functions import fixed_values as fv

# Literals, quoted names and comments, so that words inside them are not judged.
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)
_ESCAPES = ("reflect", "java_method", "try_reflect")
# Leaves of a parsed statement other than relations: no FROM, VALUES.
_PLAIN_LEAVES = ("OneRowRelation", "UnresolvedInlineTable", "LocalRelation")


class QueryRefused(ValueError):
    """The text is not a single read-only SELECT."""


def bare_text(sql: str) -> str:
    """The statement in lower case without literals, quoted names and comments."""
    return _QUOTED.sub(" ? ", sql).strip().lower()


def check_readonly(sql: str) -> str:
    """Return the statement without its closing semicolon, or raise QueryRefused."""
    bare = bare_text(sql).rstrip("; \n\t")
    if not bare:
        raise QueryRefused("Empty query")
    if ";" in bare:
        raise QueryRefused("Multiple statements are not allowed")
    if not re.match(r"(select|with)\b", bare):
        raise QueryRefused("Only SELECT queries are allowed")
    for word in (*fv.FORBIDDEN_SQL_WORDS, *_ESCAPES):
        if re.search(rf"\b{word}\b", bare):
            raise QueryRefused(f"Keyword '{word}' is not allowed in read-only queries")
    return re.sub(r"[;\s]+$", "", sql)


def check_relations(spark: SparkSession, statement: str) -> None:
    """Raise QueryRefused unless the parsed statement, with all its subqueries, reads `dataset` and its own CTEs only."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    names, ctes = set(), set()
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            names.add(tuple(p.lower() for p in _items(node.multipartIdentifier())))
        elif kind == "UnresolvedWith":
            for named in _items(node.cteRelations()):
                ctes.add((named._1().lower(),))
                waiting.append(named._2())
        elif kind.endswith("Command") or "Identifier" in kind and kind != "UnresolvedIdentifier" or "TableValuedFunction" in kind:
            raise QueryRefused(f"{kind} is not allowed")
        elif node.children().isEmpty() and kind not in _PLAIN_LEAVES:
            raise QueryRefused(f"{kind} may not be read")
        waiting += _items(node.children())
        expressions = _items(node.expressions())
        while expressions:
            e = expressions.pop()
            name = e.getClass().getSimpleName()
            if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                waiting.append(e.plan())
            elif name == "UnresolvedFunction" and _items(e.nameParts())[-1].lower() in _ESCAPES:
                raise QueryRefused("Function is not allowed")
            elif "Identifier" in name:
                raise QueryRefused(f"{name} is not allowed")
            expressions += _items(e.children())
    if ("dataset",) in ctes:
        raise QueryRefused("A CTE may not be called dataset")
    if foreign := names - ctes - {("dataset",)}:
        raise QueryRefused(f"Only dataset may be read, not {'.'.join(sorted(foreign)[0])}")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def has_own_limit(sql: str) -> bool:
    """True for a LIMIT outside all parentheses."""
    text, before = bare_text(sql), None
    while text != before:
        before, text = text, re.sub(r"\([^()]*\)", " ", text)
    return re.search(r"\blimit\b", text) is not None


def query_ledger(ledger: DataFrame, sql: str, limit: int | None = fv.QUERY_ROW_CAP) -> DataFrame:
    """Run a SELECT on `dataset`; a statement without its own LIMIT returns at most `limit` rows.

    The ledger is bound as a CTE around the statement, so neither a view of the caller called `dataset` nor any other
    view or table takes part.
    """
    statement = check_readonly(sql)
    spark = ledger.sparkSession
    check_relations(spark, statement)
    view = f"ledger_{uuid.uuid4().hex}"
    ledger.createOrReplaceTempView(view)
    try:
        result = spark.sql(f"WITH dataset AS (SELECT * FROM {view}) SELECT * FROM (\n{statement}\n)")
    finally:
        spark.catalog.dropTempView(view)
    return result if limit is None or has_own_limit(statement) else result.limit(int(limit))


def query_parquet(spark: SparkSession, path: str, sql: str, limit: int | None = fv.QUERY_ROW_CAP) -> DataFrame:
    """`query_ledger` on a written ledger."""
    return query_ledger(spark.read.parquet(path), sql, limit)
