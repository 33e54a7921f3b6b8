"""Secrets found through a trigram inverted index; columns and SQL functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyspark.llm import common
from tallyspark.sources import store

try:
    from re import _constants as ops, _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as ops
    import sre_parse as parser

#: Alternatives followed while strings are built from a pattern; beyond that the strings found so far are used.
_MOST_STRINGS = 64
_MOST_SET = 5


@dataclass(frozen=True)
class Rule:
    """Spans are the leftmost non-overlapping matches whose group `measured` has at least `least` characters."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1


# The three base rules, in the order in which kinds are listed, then the rules this method adds. The lengths
# of access and hex stand in the patterns: their matches are whole runs, and no later start within a short run is longer.
BASE_RULES = [
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{15,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, A to Z lower-cased: a match needs all trigrams of at least one. Empty: no trigram is mandatory.

    Strings that a match must contain are built from literals, small sets, short options and alternations; anything
    else ends the string built so far. A pattern that folds the case of other letters too (flag u), or whose syntax is
    not understood here, counts as one without mandatory trigrams.
    """
    runs: list[list[frozenset[str]]] = []
    if re.search(r"\(\?[a-zA-Z]*[uU]", pattern):
        return []
    try:
        _flush(_walk(parser.parse(pattern), {""}, runs), runs)
    except re.error:
        return []
    query: set[frozenset[str]] = {frozenset()}
    for run in runs:
        merged = {a | b for a, b in product(query, run)}
        if len(merged) <= _MOST_STRINGS:
            query = merged
    if frozenset() in query:
        return []
    return sorted((q for q in query if not any(o < q for o in query)), key=sorted)


def _walk(items, strings: set[str], runs: list) -> set[str]:
    for op, arg in items:
        choices = _choices(op, arg)
        if choices is not None and len(strings) * len(choices) <= _MOST_STRINGS:
            strings = {s + c for s in strings for c in choices}
            continue
        _flush(strings, runs)
        strings = {""}
        if op is ops.SUBPATTERN:
            strings = _walk(arg[-1], strings, runs)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] > 0:
            _flush(_walk(arg[2], {""}, runs), runs)
    return strings


def _low(code: int) -> str:
    """As the index folds case: A to Z only."""
    return chr(code + 32 if 65 <= code <= 90 else code)


def _choices(op, arg) -> set[str] | None:
    """All strings that an element can match, if they are few."""
    if op is ops.LITERAL:
        return {_low(arg)}
    if op is ops.IN and len(arg) <= _MOST_SET and all(o is ops.LITERAL for o, _ in arg):
        return {_low(a) for _, a in arg}
    if op is ops.SUBPATTERN:
        return _all_strings(arg[-1])
    if op is ops.BRANCH:
        found = [_all_strings(b) for b in arg[1]]
        return set().union(*found) if all(f is not None for f in found) else None
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[1] <= 1:
        once = _all_strings(arg[2])
        return None if once is None else once | ({""} if arg[0] == 0 else set())
    return None


def _all_strings(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        choices = _choices(op, arg)
        if choices is None or len(out) * len(choices) > _MOST_STRINGS:
            return None
        out = {s + c for s in out for c in choices}
    return out


def _flush(strings: set[str], runs: list) -> None:
    found = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    if all(found):
        runs.append(found)


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id, text_hash) of the given trigrams in the lower-cased texts, each once per row.

    The hash of the text tells rows apart that repeat an id or have none.
    """
    text = F.coalesce(text_col, F.lit(""))
    low = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), common.ascii_lower(text).alias("low"))
    every = F.array(*[F.lit(t) for t in trigrams])
    return low.select("id", "text_hash", F.explode(F.filter(every, lambda t: F.contains("low", t))).alias("trigram"))


def _candidates(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str, folder: str) -> DataFrame | None:
    """(id, text_hash, rules): the rules whose trigram query a document satisfies; None if no rule has one."""
    branches = [
        (rule.kind, n, t, len(q)) for rule in rules for n, q in enumerate(trigram_query(rule.pattern)) for t in sorted(q)
    ]
    if not branches:
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame(branches, "kind string, branch int, trigram string, needed int")
    postings = trigram_index(docs, sorted({t for _, _, t, _ in branches}), id_col, text_col)
    postings = store.staged(postings, folder, "postings").distinct()
    met = postings.join(F.broadcast(wanted), "trigram")  # as many rows as the rules have trigrams
    met = met.groupBy("id", "text_hash", "kind", "branch").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    return met.filter("n = needed").groupBy("id", "text_hash").agg(F.collect_set("kind").alias("rules"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_rules: list[Rule] | None = None
) -> DataFrame:
    """One row per row of `docs`: id, n_assign, n_access, n_hex, base_sha256, spans.

    Every rule's pattern gives a Boolean query over trigrams. An inverted index of those trigrams over all texts
    is intersected per alternative, and only documents that satisfy a rule's query are searched with its pattern; a rule
    without mandatory trigrams is searched in all documents. Matching is exact, on whole texts.

    Spans are kind:start:end in code points, by start, then kind as listed, comma-joined; base_sha256 is the digest of
    the base spans so joined. NULL and empty texts have no spans. Rows that repeat an id or have none are each searched, and
    meet their candidate rules by id and text hash, so only copies of one text share a task; other columns are ignored; an
    empty table gives no rows.
    """
    rules = BASE_RULES + (MORE_RULES if more_rules is None else more_rules)
    folder = common.scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    candidates = _candidates(docs, rules, id_col, text_col, folder)
    if candidates is None:
        flagged = texts.withColumn("rules", F.array().cast("array<string>"))
    else:
        found = candidates.withColumnsRenamed({"id": "_id", "text_hash": "_hash"}).hint("shuffle_hash")
        texts = texts.withColumn("text_hash", F.xxhash64("text"))
        flagged = texts.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    searched = [
        _matches(n, r, F.array_contains("rules", r.kind) if trigram_query(r.pattern) else F.lit(True)) for n, r in enumerate(rules)
    ]
    matched = store.staged(
        flagged.select(F.monotonically_increasing_id().alias("row"), "id", F.filter(F.array(*searched), lambda m: F.size(m.long) > 0).alias("found")),
        folder, "matches",
    )
    per_rule = matched.select("row", F.explode("found").alias("f")).select(
        "row", "f.rule", F.posexplode(F.arrays_zip("f.before", "f.long", "f.kept")).alias("place", "m")
    ).select("row", "rule", "place", "m.*")
    upto = W.partitionBy("row", "rule").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("long")).over(upto)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = per_rule.withColumn("end", end).filter("kept").select(
        "row", F.struct((F.col("end") - F.col("long")).alias("start"), "rule", "end").alias("s")
    ).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("s"))
    joined = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", F.element_at(kinds, s.rule + 1), s.start.cast("string"), s.end.cast("string"))), ","
    )
    n_of = lambda n: F.size(F.filter("s", lambda s: s.rule == n)).cast("long")
    full = matched.select("row", "id").join(spans, "row", "left").withColumn(
        "s", F.coalesce("s", F.array().cast(spans.schema["s"].dataType))
    )
    return full.select(
        F.col("id").alias(id_col), *[n_of(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)],
        F.sha2(joined(F.filter("s", lambda s: s.rule < len(BASE_RULES))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
    )


def _matches(n: int, rule: Rule, wanted: Column) -> Column:
    """Lengths of a rule's matches and of the text before each, and whether the match is long enough."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    long = F.transform(whole, lambda m: F.length(m).cast("long"))
    measured = long if rule.measured == 0 else F.transform(
        F.regexp_extract_all("text", pattern, F.lit(rule.measured)), lambda m: F.length(m).cast("long")
    )
    before = F.transform(F.slice(F.split("text", rule.pattern, -1), 1, F.size(whole)), lambda p: F.length(p).cast("long"))
    none = F.array().cast("array<bigint>")
    hit = wanted & F.col("text").rlike(rule.pattern)
    return F.struct(
        F.lit(n).alias("rule"), F.when(hit, before).otherwise(none).alias("before"), F.when(hit, long).otherwise(none).alias("long"),
        F.when(hit, F.transform(measured, lambda m: m >= rule.least)).otherwise(F.array().cast("array<boolean>")).alias("kept"),
    )

