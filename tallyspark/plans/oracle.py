"""DuckDB statements that state the result of each registered query independently."""

from __future__ import annotations

from tallyspark.functions import fixed_values as fv
from tallyspark.plans.catalogue import SQL_CTE, SQL_GROUP
from tallyspark.plans.portable import COLUMNS, EXTREME, FINDINGS, LEDGER, RAW

ORACLE_SQL: dict[str, str] = {}

ROLES = ["invoice_no", "vendor", "amount", "date", "entry_date", "timestamp"]
LEDGER_COLUMNS = ["row_index", *ROLES]


def _on(ctes: str, **selects: str) -> None:
    for name, select in selects.items():
        text = select.strip()
        joint = ", " if text.startswith(",") else " "
        ORACLE_SQL[name] = f"WITH {ctes}{joint}{text.lstrip(',').strip()}"


# --- cleaning

DATE_FORMATS = [
    "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%m/%d/%y", "%m/%d/%Y", "%d/%m/%Y", "%m/%d/%Y %I:%M %p", "%Y-%m-%d %I:%M:%S %p", "%d-%b-%y",
    "%d %b %y", "%b %d, %Y %H:%M", "%Y.%m.%d", "%m.%d.%Y", "%a, %d %b %Y",
]
DATE = "coalesce(" + ", ".join(f"try_strptime({{0}}, '{f}')" for f in DATE_FORMATS) + (
    ", try_strptime(regexp_replace({0}, '^Wednesday, +', ''), '%d %b %Y'))"
)

STEPS = RAW + f""",
stripped AS (SELECT row_index, trim(amount_raw) AS amount_raw, trim(date_raw) AS date_raw, trim(memo_raw) AS memo_raw FROM raw),
guarded AS (SELECT row_index,
  CASE WHEN substr(amount_raw,1,1) IN ('=','+','-','@') THEN '''' || amount_raw ELSE amount_raw END AS amount_raw,
  CASE WHEN substr(date_raw,1,1) IN ('=','+','-','@') THEN '''' || date_raw ELSE date_raw END AS date_raw,
  CASE WHEN substr(memo_raw,1,1) IN ('=','+','-','@') THEN '''' || memo_raw ELSE memo_raw END AS memo_raw FROM stripped),
nulled AS (SELECT row_index,
  CASE WHEN lower(amount_raw) NOT IN ('','na','n/a','null','none','nan','-','--') THEN amount_raw END AS amount_raw,
  CASE WHEN lower(date_raw) NOT IN ('','na','n/a','null','none','nan','-','--') THEN date_raw END AS date_raw,
  CASE WHEN lower(memo_raw) NOT IN ('','na','n/a','null','none','nan','-','--') THEN memo_raw END AS memo_raw FROM guarded),
deduped AS (SELECT min(row_index) AS row_index, amount_raw, date_raw, memo_raw FROM nulled GROUP BY amount_raw, date_raw, memo_raw),
cells AS (SELECT 0 AS ordinal, 'amount_raw' AS column_name, amount_raw AS v FROM deduped
  UNION ALL SELECT 1, 'date_raw', date_raw FROM deduped UNION ALL SELECT 2, 'memo_raw', memo_raw FROM deduped),
votes AS (SELECT ordinal, column_name, count(v) AS non_null,
  avg(CASE WHEN v IS NOT NULL THEN CAST(regexp_matches(v, '^\\(?-?\\$?\\s?[\\d,]+\\.?\\d*\\)?%?$') AS INT) END) AS numeric_share,
  avg(CASE WHEN v IS NOT NULL THEN CAST({DATE.format('v')} IS NOT NULL AS INT) END) AS date_share
  FROM cells GROUP BY ordinal, column_name),
typed AS (SELECT *, CASE WHEN numeric_share >= 0.8 THEN 'numeric' WHEN date_share >= 0.8 THEN 'date' ELSE 'text' END AS type FROM votes)"""

_on(
    STEPS,
    ingest_csv="""SELECT row_index::VARCHAR AS key, CASE WHEN amount_raw <> 'N/A' THEN amount_raw END AS amount_raw,
      CASE WHEN date_raw <> 'null' THEN date_raw END AS date_raw, memo_raw FROM raw""",
    clean_strip="SELECT * FROM stripped",
    clean_sanitize="SELECT * FROM guarded",
    clean_nulls="SELECT * FROM nulled",
    clean_dedup="SELECT * FROM deduped",
    detect_types="""SELECT ordinal, column_name AS "column", non_null, round(numeric_share, 6) AS numeric_share,
      round(date_share, 6) AS date_share, type FROM typed""",
    clean_numeric="""SELECT row_index, CASE WHEN amount_raw LIKE '(%' AND amount_raw LIKE '%)' THEN -1 ELSE 1 END
      * TRY_CAST(regexp_replace(amount_raw, '[()$,%]', '', 'g') AS DOUBLE) AS amount FROM nulled""",
    clean_dates=f"SELECT row_index, {DATE.format('date_raw')} AS date FROM nulled",
    cleaning_log="""SELECT 0 AS seq, 'normalize_nulls' AS step, NULL::VARCHAR AS "column",
        (SELECT count(*) FILTER (amount_raw IS NULL) + count(*) FILTER (date_raw IS NULL) + count(*) FILTER (memo_raw IS NULL) FROM nulled) AS count
      UNION ALL SELECT 1, 'drop_duplicate_rows', NULL, (SELECT count(*) FROM nulled) - (SELECT count(*) FROM deduped)
      UNION ALL SELECT ordinal + 2, 'coerce_' || type, column_name, NULL FROM typed WHERE type <> 'text'""",
)

# --- profiling and stored tables


def _per_column(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        template.format(i=LEDGER_COLUMNS.index(n) - 1, c=n, t={"amount": "numeric"}.get(n, "text" if n in ("invoice_no", "vendor") else "date"))
        for n in names
    )


PROFILE = LEDGER + ", prof AS (" + _per_column(
    "SELECT {i} AS ordinal, '{c}' AS \"column\", '{t}' AS type, count(*) AS row_count, count(*) - count({c}) AS null_count, "
    "round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, count(DISTINCT {c}) AS unique_count FROM ledger", ROLES
) + "), samples AS (" + _per_column(
    "SELECT * FROM (SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY row_index) AS position, CAST({c} AS VARCHAR) AS value "
    "FROM ledger WHERE {c} IS NOT NULL) WHERE position <= 5", ROLES
) + ")"

_on(
    PROFILE,
    write_read_parquet="SELECT * FROM ledger",
    profile_columns="SELECT * FROM prof",
    profile_sketches='SELECT ordinal, "column", row_count, null_count, null_pct, true AS within_bound FROM prof',
    column_heavy_hitters=" UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL "
        "GROUP BY ALL ORDER BY n DESC, value LIMIT 5)" for t, c in (("ledger", "vendor"), ("orders", "o_custkey"), ("lineitem", "l_partkey"))),
    vendor_lookup="""SELECT 'vendor' AS lookup, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total FROM ledger
        WHERE vendor = (SELECT min(c_name) FROM customer WHERE c_custkey % 9 >= 4)
      UNION ALL SELECT 'invoice', count(*), CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) FROM ledger
        WHERE invoice_no = (SELECT 'INV-' || (100000 + max(o_orderkey)) FROM orders WHERE o_orderkey % 13 <> 0)""",
    profile_samples="SELECT * FROM samples",
    profile_numeric="""SELECT 'amount' AS "column", round(avg(amount), 4) AS mean, round(median(amount), 4) AS median,
      round(stddev_samp(amount), 4) AS std, min(amount) AS min, max(amount) AS max FROM ledger""",
    profile_dates=_per_column(
        "SELECT '{c}' AS \"column\", min({c}) AS min_date, max({c}) AS max_date FROM ledger", ["date", "entry_date", "timestamp"]
    ),
    profile_dataset="""SELECT max(row_count) AS row_count, count(*) AS column_count,
      round(100 - sum(null_count) / sum(row_count) * 100, 2) AS completeness_pct FROM prof""",
    quality_summary="""SELECT sum(null_count)::BIGINT AS total_nulls, count(*) FILTER (null_count > 0) AS columns_with_nulls,
      max(null_pct) AS highest_null_pct FROM prof""",
    schema_digest="""SELECT ordinal, "column", '- ' || "column" || ' (' || type || '), examples: [' ||
      (SELECT string_agg('''' || value || '''', ', ' ORDER BY position) FROM samples s
        WHERE s."column" = prof."column" AND position <= 3) || ']' AS line FROM prof""",
    canonicalize="""SELECT row_index, invoice_no AS inv_no, vendor AS vendor_name, amount AS amount, date AS transaction_date,
      entry_date, vendor, date, invoice_no FROM ledger""",
    vendor_summary="""SELECT vendor, count(*) AS transaction_count, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total_spend,
      CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) / count(amount) AS avg_amount, min(amount) AS min_amount, max(amount) AS max_amount,
      min(date) AS first_date, max(date) AS last_date FROM ledger WHERE vendor IS NOT NULL GROUP BY vendor""",
    column_top_values="""SELECT vendor AS value, count(*) AS n, (SELECT count(DISTINCT vendor) FROM ledger) AS unique_count
      FROM ledger WHERE vendor IS NOT NULL GROUP BY vendor ORDER BY n DESC, value LIMIT 5""",
    sql_limit="SELECT row_index, amount FROM ledger ORDER BY row_index LIMIT 50",
    finding_evidence="""SELECT * FROM (SELECT vendor AS finding_key, row_index, amount,
      row_number() OVER (PARTITION BY vendor ORDER BY row_index) AS position FROM ledger WHERE vendor IS NOT NULL) WHERE position <= 25""",
)
_on(LEDGER, sql_group=SQL_GROUP.replace("dataset", "ledger"))
_on(LEDGER, sql_cte=", " + SQL_CTE.removeprefix("WITH ").replace("dataset", "ledger"))
ORACLE_SQL["column_stats"] = """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT 'l_extendedprice' AS "column", round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 6) AS median,
 round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
 round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
 count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS outlier_count
FROM lineitem, q"""

# --- schema

WORDS = ", ".join(
    f"('{role}', {i}, {repr(fv.ROLE_TYPES[role]) if fv.ROLE_TYPES[role] else 'NULL'}, '{word}', {j})"
    for i, (role, words) in enumerate(fv.ROLE_KEYWORDS.items()) for j, word in enumerate(words)
)
CANDIDATES = COLUMNS + f""",
words AS (SELECT * FROM (VALUES {WORDS}) AS w(role, role_order, required_type, keyword, keyword_order)),
matched AS (SELECT c.dataset_id, w.role, w.role_order, c.name AS "column", c.ordinal, w.keyword,
  replace(lower(trim(c.name)), ' ', '_') AS norm,
  row_number() OVER (PARTITION BY c.dataset_id, c.ordinal, w.role ORDER BY w.keyword_order) AS rn
  FROM columns_of c JOIN words w ON contains(replace(lower(trim(c.name)), ' ', '_'), w.keyword)
   AND (w.required_type IS NULL OR w.required_type = c.type)),
candidates AS (SELECT dataset_id, role, role_order, "column", ordinal, keyword,
  100 - abs(length(norm) - length(keyword)) + CASE WHEN norm = keyword THEN 50 ELSE 0 END AS score FROM matched WHERE rn = 1)"""
_on(CANDIDATES, role_candidates='SELECT dataset_id, role, "column", ordinal, keyword, score FROM candidates')
ORACLE_SQL["role_mapping"] = f"""WITH RECURSIVE {CANDIDATES},
ordered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, role_order, ordinal) AS i FROM candidates),
walk AS (
 SELECT dataset_id, i, [role] AS roles, ["column"] AS cols, [score] AS scores FROM ordered WHERE i = 1
 UNION ALL
 SELECT w.dataset_id, o.i,
  CASE WHEN list_contains(w.roles, o.role) OR list_contains(w.cols, o."column") THEN w.roles ELSE list_append(w.roles, o.role) END,
  CASE WHEN list_contains(w.roles, o.role) OR list_contains(w.cols, o."column") THEN w.cols ELSE list_append(w.cols, o."column") END,
  CASE WHEN list_contains(w.roles, o.role) OR list_contains(w.cols, o."column") THEN w.scores ELSE list_append(w.scores, o.score) END
 FROM walk w JOIN ordered o ON o.dataset_id = w.dataset_id AND o.i = w.i + 1),
final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY i DESC) = 1)
SELECT dataset_id, unnest(roles) AS role, unnest(cols) AS "column", unnest(scores) AS score FROM final"""
ORACLE_SQL["quality_gate"] = f"""
WITH d AS (SELECT o_custkey AS dataset_id, count(*) AS n FROM orders GROUP BY 1)
SELECT dataset_id, nullif(concat_ws('; ', CASE WHEN n < 10 THEN '{fv.GATE_FEW_ROWS}' END,
 CASE WHEN dataset_id % 4 = 0 THEN '{fv.GATE_NO_COLUMNS}' END, CASE WHEN dataset_id % 3 = 0 THEN '{fv.GATE_NO_ROLES}' END), '') AS error
FROM d"""

# --- rules

HITS = LEDGER + """,
invoice_groups AS (SELECT invoice_no, vendor, amount, date, count(*) AS duplicate_count, amount * (count(*) - 1) AS total_exposure
  FROM ledger WHERE invoice_no IS NOT NULL AND vendor IS NOT NULL AND amount IS NOT NULL
  GROUP BY invoice_no, vendor, amount, date HAVING count(*) > 1),
pairs AS (SELECT a.vendor, a.amount, a.row_index AS row_a, b.row_index AS row_b, date_sub('day', a.date, b.date) AS days_apart,
    a.date AS date_a, b.date AS date_b
  FROM ledger a JOIN ledger b ON a.vendor = b.vendor AND a.amount = b.amount
   AND (a.date < b.date OR (a.date = b.date AND a.row_index < b.row_index))
  WHERE date_sub('day', a.date, b.date) <= 7 AND NOT coalesce(a.invoice_no = b.invoice_no, false)),
numbers AS (SELECT DISTINCT CAST(regexp_extract(invoice_no, '[0-9]+') AS BIGINT) AS n FROM ledger WHERE invoice_no IS NOT NULL),
gap AS (SELECT min(n) AS first_number, max(n) AS last_number, count(*) AS actual_count, max(n) - min(n) + 1 AS expected_count,
   max(n) - min(n) + 1 - count(*) AS missing_count,
   CAST(max(n) - min(n) + 1 - count(*) AS DOUBLE) / (max(n) - min(n) + 1) * 100 AS gap_pct FROM numbers),
splits AS (SELECT vendor, date, count(*) AS transaction_count, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total_amount
  FROM ledger WHERE vendor IS NOT NULL AND amount IS NOT NULL GROUP BY vendor, date
  HAVING count(*) >= 2 AND sum(CAST(amount AS DECIMAL(28,6))) > 50000 AND sum(CAST(amount AS DECIMAL(28,6))) % 1 = 0),
digits AS (SELECT CAST(regexp_extract(CAST(abs(amount) AS VARCHAR), '[1-9]') AS INT) AS d FROM ledger WHERE abs(amount) > 0),
digit_share AS (SELECT r.d AS digit, (SELECT count(*) FROM digits x WHERE x.d = r.d) AS observed,
   (SELECT count(*) FROM digits) AS n, log10(1 + 1.0 / r.d) AS share FROM (SELECT unnest(range(1, 10)) AS d) r),
digit_table AS (SELECT digit, observed, n, n * share AS expected, round(observed / n * 100, 2) AS observed_pct,
   round(share * 100, 2) AS expected_pct FROM digit_share),
benford AS (SELECT max(n) AS sample_size, sum((observed - expected) ** 2 / expected) AS chi FROM digit_table),
worst AS (SELECT digit, observed, observed_pct, expected_pct FROM digit_table ORDER BY round(observed_pct - expected_pct, 2) DESC, digit LIMIT 1),
benford_test AS (SELECT sample_size, chi, exp(-chi/2) * (1 + chi/2 + (chi/2)**2/2 + (chi/2)**3/6) AS p FROM benford),
evidence AS (SELECT l.* FROM ledger l, worst w WHERE abs(amount) > 0
   AND CAST(regexp_extract(CAST(abs(amount) AS VARCHAR), '[1-9]') AS INT) = w.digit ORDER BY row_index LIMIT 25),
gaps AS (SELECT *, date_sub('day', lag(date) OVER (PARTITION BY vendor ORDER BY date, row_index), date) AS days
   FROM ledger WHERE vendor IS NOT NULL),
dormant AS (SELECT * FROM gaps WHERE days > 180),
seen AS (SELECT *, date_sub('day', min(date) OVER (PARTITION BY vendor), date) AS days FROM ledger
   WHERE vendor IS NOT NULL AND amount IS NOT NULL),
fresh AS (SELECT * FROM seen WHERE days <= 30 AND abs(amount) > 10000),
spend AS (SELECT vendor, sum(CAST(abs(amount) AS DECIMAL(28,6))) AS exact FROM ledger
   WHERE vendor IS NOT NULL AND amount IS NOT NULL GROUP BY vendor),
shares AS (SELECT *, vendor_spend / total_spend * 100 AS concentration_pct FROM (SELECT vendor, CAST(exact AS DOUBLE) AS vendor_spend,
   (SELECT CAST(sum(exact) AS DOUBLE) FROM spend) AS total_spend FROM spend)),
heavy AS (SELECT * FROM shares WHERE concentration_pct > 40),
missing AS (SELECT *, concat_ws(',', CASE WHEN vendor IS NULL THEN 'vendor' END, CASE WHEN amount IS NULL THEN 'amount' END,
   CASE WHEN date IS NULL THEN 'date' END, CASE WHEN invoice_no IS NULL THEN 'invoice_no' END) AS fields FROM ledger
   WHERE vendor IS NULL OR amount IS NULL OR date IS NULL OR invoice_no IS NULL),
weekend AS (SELECT * FROM ledger WHERE isodow(date) >= 6),
holiday AS (SELECT * FROM ledger WHERE strftime(date, '%m-%d') IN ('01-01', '07-04', '12-25', '11-11', '06-19')),
night AS (SELECT * FROM ledger WHERE hour(timestamp) < 7 OR hour(timestamp) >= 19),
backdated AS (SELECT *, date_sub('day', date, entry_date) AS days FROM ledger WHERE date_sub('day', date, entry_date) > 30),
round_amounts AS (SELECT * FROM ledger WHERE amount % 1 = 0 AND abs(amount) > 1000),
breaches AS (SELECT * FROM ledger WHERE abs(amount) > 50000)"""

_on(
    HITS,
    rule_duplicate_invoice="SELECT * FROM invoice_groups",
    rule_duplicate_payment="SELECT vendor, amount, row_a, row_b, CAST(days_apart AS INT) AS days_apart FROM pairs",
    rule_sequential_gap="""SELECT first_number, last_number, actual_count, expected_count, missing_count, gap_pct FROM gap WHERE actual_count >= 10 AND gap_pct > 5""",
    sequential_gap_missing="""SELECT m.n AS missing_number FROM (SELECT unnest(range(first_number, last_number)) AS n FROM gap) m
      WHERE NOT EXISTS (SELECT 1 FROM numbers x WHERE x.n = m.n) ORDER BY m.n LIMIT 25""",
    rule_missing_required_field="SELECT row_index, fields AS missing_fields FROM missing",
    rule_weekend_posting="SELECT row_index, date FROM weekend",
    rule_public_holiday="SELECT row_index, date FROM holiday",
    rule_after_hours="SELECT row_index, timestamp FROM night",
    rule_backdated="SELECT row_index, date, entry_date, CAST(days AS INT) AS days FROM backdated",
    rule_round_dollar="SELECT row_index, amount FROM round_amounts",
    rule_threshold_breach="SELECT row_index, amount FROM breaches",
    rule_split_transaction="SELECT * FROM splits",
    benford_digits="SELECT digit, observed, round(expected, 6) AS expected, observed_pct, expected_pct FROM digit_table",
    rule_benford="""SELECT sample_size, round(chi, 4) AS chi_squared, round(p, 10) AS p_value,
      (SELECT digit FROM worst) AS worst_digit FROM benford_test WHERE sample_size >= 100 AND p < 0.05""",
    benford_evidence="SELECT row_index, amount FROM evidence",
    rule_dormant_vendor="SELECT row_index, vendor, date, CAST(days AS INT) AS days FROM dormant",
    rule_new_vendor_high_value="SELECT row_index, vendor, amount, CAST(days AS INT) AS days FROM fresh",
    rule_vendor_concentration="SELECT vendor, vendor_spend, total_spend, concentration_pct FROM heavy",
)

_on(HITS,
    stream_row_rules=" UNION ALL ".join(f"SELECT '{rule}' AS rule_id, row_index FROM {relation}" for rule, relation in (
        ("MISSING_REQUIRED_FIELD", "missing"), ("WEEKEND_POSTING", "weekend"), ("PUBLIC_HOLIDAY_POSTING", "holiday"),
        ("AFTER_HOURS_ENTRY", "night"), ("BACKDATED_ENTRY", "backdated"), ("ROUND_DOLLAR", "round_amounts"), ("THRESHOLD_BREACH", "breaches"))),
    stream_duplicate_payment="SELECT vendor, amount, row_a, row_b, CAST(days_apart AS INT) AS days_apart FROM pairs",
    duplicate_payment_batches="SELECT vendor, amount, row_a, row_b, CAST(days_apart AS INT) AS days_apart FROM pairs",
    vendor_rule_batches="""SELECT 'DORMANT_VENDOR' AS rule_id, row_index, CAST(days AS INT) AS days FROM dormant
      UNION ALL SELECT 'NEW_VENDOR_HIGH_VALUE', row_index, CAST(days AS INT) FROM fresh""",
    stream_split_transaction="SELECT vendor, CAST(date AS DATE) AS day, transaction_count, total_amount FROM splits",
)

ROW = "invoice_no, vendor, amount, date, entry_date, timestamp"


def _flagged(rule_id: str, relation: str, days: str = "NULL", fields: str = "''") -> str:
    return (
        f"SELECT '{rule_id}' AS rule_id, row_index, {ROW}, CAST({days} AS INT) AS days, {fields} AS missing_fields FROM {relation}"
    )


_on(HITS, finding_rows=" UNION ALL ".join([
    _flagged("DUPLICATE_INVOICE", "ledger SEMI JOIN invoice_groups USING (invoice_no, vendor, amount, date)"),
    _flagged("DUPLICATE_PAYMENT", "ledger JOIN (SELECT row_a AS r FROM pairs UNION ALL SELECT row_b FROM pairs) ON r = row_index"),
    _flagged("MISSING_REQUIRED_FIELD", "missing", fields="fields"),
    _flagged("WEEKEND_POSTING", "weekend"), _flagged("PUBLIC_HOLIDAY_POSTING", "holiday"),
    _flagged("AFTER_HOURS_ENTRY", "night"), _flagged("BACKDATED_ENTRY", "backdated", days="days"),
    _flagged("ROUND_DOLLAR", "round_amounts"), _flagged("THRESHOLD_BREACH", "breaches"),
    _flagged("SPLIT_TRANSACTION", "(SELECT * FROM ledger WHERE amount IS NOT NULL) SEMI JOIN splits USING (vendor, date)"),
    _flagged("BENFORDS_LAW", "evidence"), _flagged("DORMANT_VENDOR", "dormant", days="days"),
    _flagged("NEW_VENDOR_HIGH_VALUE", "fresh", days="days"),
]))


def _said(rule_id: str, *args: str) -> str:
    """The explanation format with SQL expressions in its gaps."""
    parts = fv.EXPLANATION_FORMATS[rule_id].split("%s")
    quoted = ["'" + p.replace("%%", "%").replace("'", "''") + "'" for p in parts]
    pieces = [quoted[0]] + [x for a, q in zip(args, quoted[1:]) for x in (a, q)]
    return "concat(" + ", ".join(pieces) + ")"


def _found(rule_id: str, relation: str, n_rows: str, said: str, where: str = "true", **inputs: str) -> str:
    name, severity = next((r[1], r[2]) for r in fv.RULES if r[0] == rule_id)
    kinds = {"total_exposure": "DOUBLE", "duplicate_count": "BIGINT", "p_value": "DOUBLE",
             "concentration_pct": "DOUBLE", "threshold_pct": "DOUBLE", "gap_pct": "DOUBLE"}
    typed = ", ".join(f"CAST({inputs.get(k, 'NULL')} AS {t}) AS {k}" for k, t in kinds.items())
    name = name.replace("'", "''")
    return (
        f"SELECT '{rule_id}' AS rule_id, '{name}' AS rule_name, '{severity}' AS severity, "
        f"CAST({n_rows} AS BIGINT) AS n_rows, {typed}, {said} AS audit_explanation FROM {relation} WHERE {where}"
    )


def _counted(rule_id: str, relation: str, *extra: str) -> str:
    source = f"(SELECT count(*) AS n FROM {relation})"
    return _found(rule_id, source, "n", _said(rule_id, "n", *extra), "n > 0")


BOOST = """CASE WHEN total_exposure IS NULL THEN 0 ELSE least(10, total_exposure / 50000.0 * 5) END
 + CASE WHEN duplicate_count IS NULL THEN 0 ELSE least(5, greatest(0, duplicate_count - 2) * 2) END
 + CASE WHEN p_value < 0.05 THEN least(10, (0.05 - p_value) * 100) ELSE 0 END
 + CASE WHEN concentration_pct IS NULL THEN 0 ELSE least(10, greatest(0, concentration_pct - coalesce(threshold_pct, 40)) / 2.0) END
 + CASE WHEN gap_pct IS NULL THEN 0 ELSE least(10, greatest(0, gap_pct - 5) / 2.0) END"""
BASE = "CASE severity WHEN 'HIGH' THEN 85 WHEN 'MEDIUM' THEN 60 WHEN 'LOW' THEN 30 ELSE 50 END"
SCORE = f"CAST(greatest(0, least(100, round_even(CAST({BASE} + {BOOST} AS DOUBLE), 0))) AS INT)"

FOUND = HITS + ", found AS (" + " UNION ALL ".join([
    _found("DUPLICATE_INVOICE", "invoice_groups", "duplicate_count", _said(
        "DUPLICATE_INVOICE", "invoice_no", "duplicate_count", "vendor", "amount::VARCHAR", "date::VARCHAR", "total_exposure::VARCHAR"),
        total_exposure="total_exposure", duplicate_count="duplicate_count"),
    _found("DUPLICATE_PAYMENT", "pairs", "2", _said("DUPLICATE_PAYMENT", "amount::VARCHAR", "vendor", "days_apart")),
    _found("SEQUENTIAL_GAP", "gap", "0", _said(
        "SEQUENTIAL_GAP", "first_number", "last_number", "expected_count", "actual_count", "missing_count",
        "printf('%.1f', gap_pct::DOUBLE)"), "actual_count >= 10 AND gap_pct > 5", gap_pct="round(gap_pct, 2)"),
    _counted("MISSING_REQUIRED_FIELD", "missing", "'[''vendor'', ''amount'', ''date'', ''invoice_no'']'"),
    _counted("WEEKEND_POSTING", "weekend"), _counted("PUBLIC_HOLIDAY_POSTING", "holiday"),
    _counted("AFTER_HOURS_ENTRY", "night", "'07:00-19:00'"), _counted("BACKDATED_ENTRY", "backdated", "30"),
    _counted("ROUND_DOLLAR", "round_amounts", "1000"), _counted("THRESHOLD_BREACH", "breaches", "50000"),
    _found("SPLIT_TRANSACTION", "splits", "transaction_count", _said(
        "SPLIT_TRANSACTION", "vendor", "transaction_count", "date::VARCHAR", "total_amount::VARCHAR", "50000")),
    _found("BENFORDS_LAW", "benford_test, worst", "least(25, observed)", _said(
        "BENFORDS_LAW", "sample_size", "printf('%.2f', chi)", "printf('%.4f', p)", "0.05", "digit",
        "observed_pct::DOUBLE::VARCHAR", "expected_pct::DOUBLE::VARCHAR"), "sample_size >= 100 AND p < 0.05", p_value="p"),
    _counted("DORMANT_VENDOR", "dormant", "180"),
    _counted("NEW_VENDOR_HIGH_VALUE", "fresh", "10000", "30"),
    _found("SINGLE_VENDOR_CONCENTRATION", "heavy", "0", _said(
        "SINGLE_VENDOR_CONCENTRATION", "vendor", "printf('%.1f', concentration_pct)", "format('{:,.2f}', vendor_spend)",
        "format('{:,.2f}', total_spend)", "40"), concentration_pct="round(concentration_pct, 2)", threshold_pct="40"),
]) + ")"

_on(FOUND, findings_all=f"""SELECT rule_id, rule_name, severity, n_rows, round(total_exposure, 4) AS total_exposure, duplicate_count,
  round(p_value, 4) AS p_value, round(concentration_pct, 4) AS concentration_pct, threshold_pct, round(gap_pct, 4) AS gap_pct,
  audit_explanation, {SCORE} AS risk_score FROM found""",
    persist_findings="""SELECT d.dataset_id, rule_id, 'PENDING' AS status, count(*) AS n_findings, sum(n_rows)::BIGINT AS n_rows
      FROM found, (VALUES ('one'), ('two')) AS d(dataset_id) WHERE d.dataset_id = 'two' OR rule_id IN ('THRESHOLD_BREACH', 'SPLIT_TRANSACTION')
      GROUP BY ALL""",
    rerun_reset="""SELECT 'reviewed before' AS moment, 'CONFIRMED' AS status, count(*) AS n_findings FROM found WHERE rule_id = 'SPLIT_TRANSACTION'
      UNION ALL SELECT 'after the rerun', 'PENDING', count(*) FROM found WHERE rule_id = 'SPLIT_TRANSACTION'""",
    delete_then_rerun="""SELECT m.moment, 'two' AS dataset_id, count(*) AS n_findings FROM found, (VALUES ('deleted'), ('written again')) AS m(moment)
      WHERE rule_id = 'SPLIT_TRANSACTION' GROUP BY ALL
      UNION ALL SELECT 'written again', 'one', count(*) FROM found WHERE rule_id = 'SPLIT_TRANSACTION'""",
    interleaved_writers="""SELECT 'first commit' AS moment, 'one' AS dataset_id, count(*) AS n_findings FROM found
        WHERE rule_id = 'SPLIT_TRANSACTION' AND n_rows > 2 HAVING count(*) > 0
      UNION ALL SELECT 'second commit', 'one', count(*) FROM found WHERE rule_id = 'SPLIT_TRANSACTION'""",
    purge_versions="""SELECT m.*, 1 AS n_current, (SELECT count(*) FROM found WHERE rule_id = 'SPLIT_TRANSACTION') AS n_findings
      FROM (VALUES ('before', 'one', 3), ('before', 'two', 1), ('after', 'one', 1), ('after', 'two', 1)) AS m(moment, dataset_id, n_versions)""",
)

_on(
    EXTREME + """,
numbers AS (SELECT DISTINCT ltrim(regexp_extract(invoice_no, '[0-9]+'), '0') AS t FROM extreme WHERE invoice_no IS NOT NULL),
ends AS (SELECT min(TRY_CAST(t AS BIGINT)) AS low, count(*) AS n FROM numbers),
known AS (SELECT vendor, date, amount FROM extreme WHERE vendor IS NOT NULL AND amount IS NOT NULL),
spend AS (SELECT vendor, sum(abs(amount)) AS s FROM known GROUP BY vendor)""",
    extreme_gap="""SELECT low::VARCHAR AS first_number, '1' || repeat('0', 44) AS last_number, n AS actual_count,
      '99999999999999' || (1000000000000000000000000000000::HUGEINT - low + 1)::VARCHAR AS expected_count,
      '99999999999999' || (1000000000000000000000000000000::HUGEINT - low + 1 - n)::VARCHAR AS missing_count, 100.0::DOUBLE AS gap_pct FROM ends""",
    extreme_missing="""SELECT m.n::VARCHAR AS missing_number FROM (SELECT unnest(range(low, low + 100000)) AS n FROM ends) m
      WHERE m.n::VARCHAR NOT IN (SELECT t FROM numbers) ORDER BY m.n LIMIT 25""",
    extreme_concentration="""SELECT vendor, round(s / (SELECT sum(s) FROM spend) * 100, 6) AS concentration_pct FROM spend
      WHERE s / (SELECT sum(s) FROM spend) > 0.4""",
    extreme_monthly="""SELECT vendor, strftime(date, '%Y-%m') AS month, CASE WHEN vendor = 'Vast' THEN round(sum(amount) / 1e20, 3)
      ELSE sum(CAST(amount AS DECIMAL(38,8)))::DOUBLE END AS total FROM known GROUP BY 1, 2""",
    extreme_split="""SELECT vendor, date, count(*) AS transaction_count, round(sum(amount) / 1e20, 3) AS total FROM known WHERE vendor = 'Vast'
      GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT vendor, date, count(*), round(sum(amount) / 1e20, 3) FROM known WHERE vendor <> 'Vast' GROUP BY ALL
      HAVING count(*) > 1 AND sum(CAST(amount AS DECIMAL(38,8))) > 50000 AND sum(CAST(amount AS DECIMAL(38,8))) % 1 = 0""",
)

# --- statistics

_on(
    LEDGER + """,
money AS (SELECT * FROM ledger WHERE amount IS NOT NULL),
known AS (SELECT * FROM money WHERE vendor IS NOT NULL),
spread AS (SELECT avg(amount) AS mean, stddev_samp(amount) AS std FROM money),
q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM money),
fence AS (SELECT q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
monthly AS (SELECT vendor, strftime(date, '%Y-%m') AS month, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) AS total
  FROM known GROUP BY 1, 2),
top AS (SELECT vendor, CAST(sum(CAST(abs(amount) AS DECIMAL(28,6))) AS DOUBLE) AS spend FROM known GROUP BY vendor
  ORDER BY sum(CAST(abs(amount) AS DECIMAL(28,6))) DESC, vendor LIMIT 50),
lagged AS (SELECT m.*, lag(total) OVER (PARTITION BY vendor ORDER BY month) AS before FROM monthly m SEMI JOIN top USING (vendor)),
trend AS (SELECT vendor, month, total, (total - before) / before * 100 AS pct_change FROM lagged)""",
    stats_amount="""SELECT count(*) AS count, round(avg(amount), 4) AS mean, round(median(amount), 4) AS median,
      round(stddev_samp(amount), 4) AS std, min(amount) AS min, max(amount) AS max,
      round(quantile_cont(amount, 0.95), 4) AS p95, round(quantile_cont(amount, 0.99), 4) AS p99,
      count(*) FILTER (abs(amount - s.mean) / s.std > 3) AS outliers_zscore_count,
      count(*) FILTER (amount < lower_fence OR amount > upper_fence) AS outliers_iqr_count,
      round(any_value(lower_fence), 4) AS iqr_lower_fence, round(any_value(upper_fence), 4) AS iqr_upper_fence
      FROM money, spread s, fence""",
    stats_moments="SELECT round(skewness(amount), 6) AS skewness, round(kurtosis(amount), 6) AS kurtosis FROM money",
    outliers_zscore="""SELECT row_index, amount, round((amount - mean) / std, 6) AS zscore FROM money, spread
      WHERE abs((amount - mean) / std) > 3""",
    outliers_iqr="""SELECT row_index, amount, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence
      FROM money, fence WHERE amount < lower_fence OR amount > upper_fence""",
    vendor_monthly="SELECT * FROM monthly",
    top_vendors="SELECT * FROM top",
    vendor_trend="SELECT vendor, month, total, pct_change FROM trend",
    vendor_spikes="SELECT vendor, month, pct_change FROM trend WHERE abs(pct_change) > 50",
    vendor_variance=""", means AS (SELECT vendor, CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS m FROM known GROUP BY vendor),
      overall AS (SELECT CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS o FROM known)
      SELECT vendor, m AS vendor_mean, o AS overall_mean, (m - o) / o * 100 AS deviation_pct
      FROM means, overall ORDER BY m DESC, vendor LIMIT 50""",
)

# --- findings and reviews

_on(
    FINDINGS + f""",
scored AS (SELECT *, {BASE} AS base, CAST({BOOST} AS DOUBLE) AS boost, {SCORE} AS risk_score FROM findings),
last_action AS (SELECT finding_id, arg_max(action, (created_at, id)) AS action FROM reviews WHERE action <> 'NOTE' GROUP BY finding_id),
status AS (SELECT f.finding_id, CASE a.action WHEN 'CONFIRM' THEN 'CONFIRMED' WHEN 'DISMISS' THEN 'DISMISSED' ELSE 'PENDING' END AS status
  FROM findings f LEFT JOIN last_action a USING (finding_id)),
full_view AS (SELECT s.*, t.status, d.dataset_name FROM scored s JOIN status t USING (finding_id) LEFT JOIN datasets d USING (dataset_id)),
ranks AS (SELECT *, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS r FROM full_view)""",
    risk_score="SELECT finding_id, risk_score FROM scored",
    risk_justification="""SELECT finding_id, concat(severity, ' severity finding for rule ''', rule_name, ''' affecting ', n_rows,
      ' row(s); base score ', base, ' adjusted by ', printf('%+.1f', round_even(boost, 1)), ' based on supporting metrics.')
      AS risk_justification FROM scored""",
    findings_export="""SELECT finding_id, rule_id, rule_name, severity, risk_score, status, audit_explanation,
      NULL::VARCHAR AS llm_enriched_explanation, n_rows AS flagged_row_count FROM full_view""",
    findings_ranked="SELECT finding_id, dataset_id, risk_score FROM scored",
    findings_search="""SELECT finding_id, dataset_name, severity, status FROM full_view WHERE severity = 'HIGH' AND status = 'PENDING'
        AND (lower(rule_name) LIKE '%urgent%' OR lower(audit_explanation) LIKE '%urgent%' OR lower(dataset_name) LIKE '%urgent%')
      UNION ALL SELECT finding_id, dataset_name, severity, status FROM full_view WHERE severity = 'LOW'
        AND (lower(rule_name) LIKE '%customer#%' OR lower(audit_explanation) LIKE '%customer#%' OR lower(dataset_name) LIKE '%customer#%')""",
    findings_sorted="SELECT finding_id, severity, n_rows FROM findings",
    findings_by_dataset="""SELECT dataset_id, coalesce(max(dataset_name), dataset_id::VARCHAR) AS dataset_name,
      CASE max(r) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS max_severity, count(*) AS n_findings FROM ranks GROUP BY dataset_id""",
    findings_by_rule="""SELECT rule_name, CASE max(r) OVER w WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS max_severity,
      count(*) OVER w AS n_findings, finding_id, severity, risk_score FROM ranks WINDOW w AS (PARTITION BY rule_name)""",
    dashboard_kpis="""SELECT (SELECT count(*) FROM datasets) AS total_datasets, count(*) AS total_findings,
      count(*) FILTER (severity = 'HIGH') AS high_findings, count(*) FILTER (status = 'PENDING') AS pending_findings FROM full_view""",
    dataset_list="SELECT * FROM datasets",
    run_summary="""SELECT concat('Analyzed ', (SELECT count(*) FROM orders), ' rows and raised ', count(*), ' finding(s): ',
      count(*) FILTER (severity = 'HIGH'), ' HIGH, ', count(*) FILTER (severity = 'MEDIUM'), ' MEDIUM, ',
      count(*) FILTER (severity = 'LOW'), ' LOW. Most frequent rule triggers: ',
      (SELECT string_agg(concat(rule_name, ' (', n, ')'), ', ' ORDER BY n DESC, rule_name) FROM
        (SELECT rule_name, count(*) AS n FROM findings GROUP BY rule_name ORDER BY n DESC, rule_name LIMIT 3)), '.') AS summary FROM findings""",
    review_status="SELECT finding_id, status FROM status",
    review_pending="SELECT finding_id, status FROM status WHERE status = 'PENDING'",
    review_bulk="""SELECT finding_id, 'CONFIRM' AS action, 'auditor' AS reviewer FROM findings
      WHERE finding_id IN (SELECT finding_id FROM reviews WHERE action = 'DISMISS')""",
    review_history="SELECT * FROM reviews",
    cascade_delete=""", gone AS (SELECT c_custkey AS dataset_id FROM customer WHERE c_nationkey < 5),
      kept AS (SELECT * FROM findings WHERE dataset_id NOT IN (SELECT dataset_id FROM gone)),
      lost AS (SELECT finding_id FROM findings WHERE dataset_id IN (SELECT dataset_id FROM gone))
      SELECT 'datasets' AS table_name, count(*) AS n_rows FROM datasets WHERE dataset_id NOT IN (SELECT dataset_id FROM gone)
      UNION ALL SELECT 'findings', count(*) FROM kept
      UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE finding_id NOT IN (SELECT finding_id FROM lost)""",
    enrichment_payload=""", first AS (SELECT * FROM findings ORDER BY finding_no LIMIT 50),
      placed AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
      SELECT finding_id, severity, (SELECT o_orderkey FROM placed WHERE o_custkey = dataset_id AND place = 1) AS first_row,
       (SELECT o_orderkey FROM placed WHERE o_custkey = dataset_id AND place = 3) AS third_row, NULL::BIGINT AS fourth_row FROM first""",
)
ORACLE_SQL["latest_per_dataset"] = """
SELECT dataset_id, created_at, version, profile FROM (
 SELECT o_custkey AS dataset_id, o_orderdate AS created_at, o_orderkey AS version, o_totalprice AS profile,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""

ORACLE_SQL["findings_search_index"] = ORACLE_SQL["findings_search"]
