"""Fixed values.

Everything in this file is data that results depend on literally: word lists,
lookup tables, default parameters, patterns and text formats. They are stated
plainly here and nowhere else.
"""

# --- fixed values: canonical roles, their column type and name keywords, in test order
ROLE_TYPES = {
    "vendor": "text",
    "amount": "numeric",
    "date": "date",
    "invoice_no": None,
    "entry_date": "date",
    "timestamp": None,
}
ROLE_KEYWORDS = {
    "vendor": ["vendor", "supplier", "payee", "party", "merchant"],
    "amount": ["amount", "total", "value", "price", "cost", "sum", "net", "gross"],
    "date": ["date", "txn_date", "transaction_date", "posting_date", "post_date"],
    "invoice_no": ["invoice", "inv_no", "inv#", "doc_no", "document_number", "invoice_number", "invoice_no"],
    "entry_date": ["entry_date", "document_date", "created_date", "doc_date"],
    "timestamp": ["timestamp", "datetime", "time"],
}

# --- fixed values: tokens read as missing by the CSV reader, and by the cleaning step
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
CLEAN_NULL_TOKENS = ["", "na", "n/a", "null", "none", "nan", "-", "--"]

# --- fixed values: characters counted as white space at the ends of a cell
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: first letters of the months
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# --- fixed values: leading characters a spreadsheet would run as a formula
FORMULA_PREFIXES = ["=", "+", "-", "@"]

# --- fixed values: patterns
NUMERIC_PATTERN = r"^\(?-?\$?\s?[\d,]+\.?\d*\)?%?$"
PLAIN_FLOAT_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TYPE_VOTE_SHARE = 0.8

# --- fixed values: rule catalogue in reporting order
#     (rule_id, rule_name, severity, category, required columns)
RULES = [
    ("DUPLICATE_INVOICE", "Duplicate Invoice Number", "HIGH", "duplicate_and_completeness",
     ["invoice_no", "vendor", "amount", "date"]),
    ("DUPLICATE_PAYMENT", "Duplicate Payment (Same Vendor/Amount, Different Invoice)", "HIGH",
     "duplicate_and_completeness", ["vendor", "amount", "date"]),
    ("SEQUENTIAL_GAP", "Sequential Invoice Number Gap", "MEDIUM", "duplicate_and_completeness", ["invoice_no"]),
    ("MISSING_REQUIRED_FIELD", "Missing Required Field", "MEDIUM", "duplicate_and_completeness", []),
    ("WEEKEND_POSTING", "Weekend Posting", "MEDIUM", "timing_and_calendar", ["date"]),
    ("PUBLIC_HOLIDAY_POSTING", "Public Holiday Posting", "MEDIUM", "timing_and_calendar", ["date"]),
    ("AFTER_HOURS_ENTRY", "After-Hours Entry", "MEDIUM", "timing_and_calendar", ["timestamp"]),
    ("BACKDATED_ENTRY", "Backdated Entry", "HIGH", "timing_and_calendar", ["date", "entry_date"]),
    ("ROUND_DOLLAR", "Round-Dollar Amount", "LOW", "amount_patterns", ["amount"]),
    ("THRESHOLD_BREACH", "Materiality Threshold Breach", "HIGH", "amount_patterns", ["amount"]),
    ("SPLIT_TRANSACTION", "Split Transaction", "HIGH", "amount_patterns", ["vendor", "amount", "date"]),
    ("BENFORDS_LAW", "Benford's Law Deviation", "MEDIUM", "amount_patterns", ["amount"]),
    ("DORMANT_VENDOR", "Dormant Vendor Reactivation", "HIGH", "vendor_behaviour", ["vendor", "date"]),
    ("NEW_VENDOR_HIGH_VALUE", "New Vendor High-Value Transaction", "HIGH", "vendor_behaviour",
     ["vendor", "date", "amount"]),
    ("SINGLE_VENDOR_CONCENTRATION", "Single Vendor Spend Concentration", "MEDIUM", "vendor_behaviour",
     ["vendor", "amount"]),
]
CHECKED_FIELDS = ["vendor", "amount", "date", "invoice_no"]

# --- fixed values: default parameters
DEFAULT_PARAMS = {
    "materiality_threshold": 50000,
    "duplicate_payment_window_days": 7,
    "public_holidays_mmdd": ["01-01", "07-04", "12-25", "11-11", "06-19"],
    "business_hours_start": 7,
    "business_hours_end": 19,
    "backdated_threshold_days": 30,
    "round_dollar_min_amount": 1000,
    "split_transaction_min_rows": 2,
    "benford_p_value": 0.05,
    "dormant_vendor_days": 180,
    "new_vendor_window_days": 30,
    "new_vendor_high_value": 10000,
    "vendor_concentration_pct": 40,
    "outlier_zscore_threshold": 3.0,
}
SEQUENCE_MIN_NUMBERS = 10
SEQUENCE_GAP_PCT = 5
SEQUENCE_SAMPLE = 25
BENFORD_MIN_ROWS = 100
BENFORD_EVIDENCE_ROWS = 25
TOP_VENDORS = 50
SPIKE_PCT = 50
IQR_FENCE = 1.5
PROFILE_SAMPLES = 5
EVIDENCE_ROWS = 25
ENRICHED_FINDINGS = 50
ENRICHED_ROWS = 3
QUERY_ROW_CAP = 500
TOOL_ROW_CAP = 50
GATE_MIN_ROWS = 10

# --- fixed values: severity base scores and ranks; review actions
SEVERITY_BASE = {"HIGH": 85, "MEDIUM": 60, "LOW": 30}
UNKNOWN_SEVERITY_BASE = 50
SEVERITY_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
ACTION_STATUS = {"CONFIRM": "CONFIRMED", "DISMISS": "DISMISSED"}
REVIEW_ACTIONS = ["CONFIRM", "DISMISS", "NOTE"]

# --- fixed values: words refused in ad-hoc SQL
FORBIDDEN_SQL_WORDS = [
    "insert", "update", "delete", "drop", "alter", "create", "attach", "copy",
    "pragma", "call", "install", "load", "export", "import",
]

# --- fixed values: text formats of messages, scores and summaries
GATE_FEW_ROWS = "Dataset has fewer than 10 rows after cleaning"
GATE_NO_COLUMNS = "Dataset has no columns"
GATE_NO_ROLES = "No canonical fields (vendor/amount/date/invoice_no) could be mapped"
JUSTIFICATION_FORMAT = (
    "%s severity finding for rule '%s' affecting %s row(s); "
    "base score %s adjusted by %s based on supporting metrics."
)
SUMMARY_NONE_FORMAT = "No findings were raised across %s rows for the enabled audit rules."
SUMMARY_FORMAT = "Analyzed %s rows and raised %s finding(s): %s. Most frequent rule triggers: %s."

# --- fixed values: text formats of finding explanations
EXPLANATION_FORMATS = {
    "DUPLICATE_INVOICE": (
        "Invoice %s was posted %s times to vendor %s for the same amount (%s) on %s. "
        "No distinguishing reversal or credit note is present in the dataset. Total exposure: %s."
    ),
    "DUPLICATE_PAYMENT": (
        "Two payments of the same amount (%s) were made to vendor %s within %s day(s) of each other "
        "under different invoice numbers. This pattern is consistent with a duplicate payment control failure."
    ),
    "SEQUENTIAL_GAP": (
        "Invoice numbering sequence spans %s-%s (%s expected), but only %s were found "
        "(%s missing, %s%% gap). Gaps above 5%% may indicate unrecorded, voided, or off-books transactions."
    ),
    "MISSING_REQUIRED_FIELD": (
        "%s row(s) are missing at least one required field among %s. Incomplete records reduce "
        "traceability and may indicate data entry control weaknesses."
    ),
    "WEEKEND_POSTING": (
        "%s transaction(s) were posted on a Saturday or Sunday. Weekend postings fall outside "
        "normal business operations and warrant review."
    ),
    "PUBLIC_HOLIDAY_POSTING": (
        "%s transaction(s) were posted on a recognized public holiday. Entries on non-business days "
        "may indicate manual overrides or backdated postings."
    ),
    "AFTER_HOURS_ENTRY": (
        "%s entries were recorded outside business hours (%s). After-hours activity may indicate "
        "unauthorized access or unusual processing."
    ),
    "BACKDATED_ENTRY": (
        "%s entries were posted with a transaction date more than %s days before the entry/document date. "
        "This pattern is consistent with backdating, which can be used to manipulate period-end results."
    ),
    "ROUND_DOLLAR": (
        "%s transaction(s) above %s are exact round-dollar amounts (no cents). Round-dollar amounts above "
        "materiality are a common indicator of estimated, fabricated, or manually-keyed entries."
    ),
    "THRESHOLD_BREACH": (
        "%s transaction(s) exceed the materiality threshold of %s. High-value transactions warrant "
        "substantive testing and supporting documentation review."
    ),
    "SPLIT_TRANSACTION": (
        "Vendor %s had %s separate transactions on %s summing to %s, a round total exceeding the "
        "materiality threshold of %s. This pattern is consistent with structuring/splitting a single "
        "transaction to avoid an approval threshold."
    ),
    "BENFORDS_LAW": (
        "The first-digit distribution of %s amount values deviates significantly from Benford's Law "
        "(chi-squared=%s, p=%s < %s). Leading digit %s is the most over-represented (%s%% observed vs "
        "%s%% expected). This may indicate fabricated, estimated, or manipulated figures across the "
        "dataset and warrants further sampling of the rows below."
    ),
    "DORMANT_VENDOR": (
        "%s transaction(s) reactivate a vendor after more than %s days of inactivity. Reactivated dormant "
        "vendors are a common indicator of shell-vendor or fictitious-vendor fraud schemes."
    ),
    "NEW_VENDOR_HIGH_VALUE": (
        "%s transaction(s) exceed %s from a vendor that first appeared within the prior %s days. New vendors "
        "transacting at high value shortly after onboarding warrant vendor master-file verification."
    ),
    "SINGLE_VENDOR_CONCENTRATION": (
        "Vendor %s accounts for %s%% of total spend (%s of %s), exceeding the %s%% concentration threshold. "
        "High vendor concentration increases dependency risk and warrants review of procurement controls "
        "and vendor independence."
    ),
}
