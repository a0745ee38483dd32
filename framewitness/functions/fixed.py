"""Fixed values.

Word lists, names, limits and patterns that results depend on. They are plain
data: no logic lives here.
"""

# --- Fixed values: issue types in the order in which they win -----------------
ISSUE_PRECEDENCE = (
    "schema_change",
    "duplicate_key",
    "null_increase",
    "date_gap",
    "total_change",
    "category_shift",
    "general_suspected_issue",
)
GENERAL = "general_suspected_issue"
MISSING = "missing_issue_statement"

# --- Fixed values: terms that select an issue type ----------------------------
ISSUE_TERMS = {
    "schema_change": (
        "schema", "column missing", "missing column", "new column",
        "removed column", "field missing", "missing field", "header changed",
    ),
    "duplicate_key": (
        "duplicate", "duplicated", "duplicating", "repeating", "repeated",
        "same id", "duplicate id", "duplicate key",
    ),
    "null_increase": (
        "null", "nulls", "blank", "missing value", "empty field",
        "blank more often", "missing email", "increased nulls",
    ),
    "date_gap": (
        "gap", "missing date", "missing day", "date gap",
        "no records for date", "no records for one day", "missing period",
    ),
    "total_change": (
        "total", "sum", "dropped", "increased", "decreased", "report total",
        "count changed", "row count changed", "volume changed",
    ),
    "category_shift": (
        "category", "status", "segment", "region", "value spiked", "spiked",
        "disappeared", "distribution", "mix changed",
    ),
}

# --- Fixed values: route name of each issue type ------------------------------
ROUTE_NAMES = {
    "duplicate_key": "duplicate_key_investigation",
    "null_increase": "null_increase_investigation",
    "date_gap": "date_gap_investigation",
    "category_shift": "category_shift_investigation",
    "total_change": "total_change_investigation",
    "schema_change": "schema_change_investigation",
    "general_suspected_issue": "general_investigation",
    "missing_issue_statement": "missing_issue_statement",
}

# --- Fixed values: words that never point at a column -------------------------
STOP_WORDS = (
    "a", "an", "and", "are", "field", "fields", "has", "have", "in", "the",
    "to", "with", "started", "increased", "decreased", "missing", "null",
    "nulls", "blank", "empty",
)

# --- Fixed values: lower-case letters that fold to more (Unicode full case folding)
FOLDS = {
    "ß": "ss", "ŉ": "ʼn", "ſ": "s", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ",
    "ẙ": "ẙ", "ẚ": "aʾ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "ﬅ": "st", "ﬆ": "st",
}

# --- Fixed values: parts of a column name that mark its role ------------------
KEY_TERMS = ("id", "key", "code", "number", "reference", "ref")
DATE_TERMS = ("date", "time", "timestamp", "period", "day", "month", "year")
CATEGORY_TERMS = ("status", "category", "type", "segment", "region")
TOTAL_TERMS = ("total", "amount", "value", "count", "quantity", "qty", "volume")

# --- Fixed values: planned checks (id, requires_baseline, requires_raw) -------
PLANNED_CHECKS = {
    "duplicate_key": (
        ("planned_duplicate_key_summary", False, True),
        ("planned_key_null_summary", False, True),
        ("planned_duplicate_pattern_review", False, False),
    ),
    "null_increase": (
        ("planned_current_null_summary", False, True),
        ("planned_baseline_null_comparison", True, False),
        ("planned_null_by_candidate_group_review", False, False),
    ),
    "date_gap": (
        ("planned_date_range_summary", False, True),
        ("planned_missing_period_detection", False, True),
        ("planned_date_frequency_review", False, True),
    ),
    "category_shift": (
        ("planned_category_distribution_summary", False, True),
        ("planned_baseline_category_comparison", True, False),
        ("planned_unexpected_category_review", False, False),
    ),
    "total_change": (
        ("planned_numeric_total_summary", False, True),
        ("planned_baseline_total_comparison", True, False),
        ("planned_row_count_change_review", True, False),
    ),
    "schema_change": (
        ("planned_current_schema_summary", False, False),
        ("planned_baseline_schema_comparison", True, False),
        ("planned_required_column_review", False, False),
    ),
    "general_suspected_issue": (
        ("planned_general_profile_review", False, False),
        ("planned_reviewer_question_capture", False, False),
    ),
}
# The one planned check that works without a profile.
NO_PROFILE_CHECK = "planned_reviewer_question_capture"

# --- Fixed values: which executed check settles a planned one -----------------
PLANNED_TO_EXECUTED = {
    "planned_duplicate_key_summary": "duplicate_key_summary",
    "planned_key_null_summary": "key_null_summary",
    "planned_current_null_summary": "current_null_summary",
    "planned_date_range_summary": "date_range_summary",
    "planned_missing_period_detection": "date_gap_summary",
    "planned_numeric_total_summary": "numeric_total_summary",
    "planned_current_schema_summary": "current_schema_summary",
    "planned_category_distribution_summary": "categorical_shape_summary",
    "planned_general_profile_review": "general_profile_signal_summary",
    "planned_baseline_null_comparison": "baseline_null_comparison",
    "planned_baseline_category_comparison": "baseline_category_shape_comparison",
    "planned_baseline_total_comparison": "baseline_total_comparison",
    "planned_baseline_schema_comparison": "baseline_schema_comparison",
}

# --- Fixed values: hypothesis and finding statuses ----------------------------
SUPPORTED = "supported_by_evidence"
NOT_SUPPORTED = "not_supported_by_evidence"
UNCLEAR = "unclear"
NOT_ASSESSED = "not_assessed"
HYPOTHESIS_STATUSES = (SUPPORTED, NOT_SUPPORTED, UNCLEAR, NOT_ASSESSED)

# --- Fixed values: limits -----------------------------------------------------
CATEGORY_SHARE_LIMIT = 50.0
DATE_PARSE_SHARE = 80.0

# --- Fixed values: metric names a report leaves out ---------------------------
UNREPORTED_METRIC_PARTS = (
    "raw", "sample", "preview", "category_label", "distribution",
    "row_number", "failing_record",
)

# --- Fixed values: notes contract ---------------------------------------------
NOTE_SUMMARY_KEY = "review_summary"
NOTE_LIST_KEYS = (
    "suggested_follow_up_questions",
    "suggested_human_checks",
    "communication_notes",
    "limitations_to_keep_visible",
)
NOTE_SUMMARY_CHARS = 1000
NOTE_LIST_ITEMS = 8
NOTE_ITEM_CHARS = 300

# --- Fixed values: text that must not leave the library -----------------------
BLOCKED_TERMS = (
    "raw_rows", "sample_rows", "sampled_rows", "first_rows", "last_rows",
    "example_values", "value_examples", "raw_examples", "top_values",
    "distinct_values", "value_preview", "value_previews",
    "raw_failing_records", "row_numbers", "duplicated_values",
    "category_labels", "full_distribution", "raw_values", "generated_code",
    "avery@example.test", "CUST-001", "root cause identified",
    "issue confirmed", "proved", "approved", "certified",
    "production-ready", "compliant verdict",
)

# --- Fixed values: field names no output may have -----------------------------
FORBIDDEN_FIELDS = (
    "raw_rows", "sample_rows", "sampled_rows", "first_rows", "last_rows",
    "example_values", "examples", "top_values", "distinct_values",
    "value_preview", "value_previews", "raw_failing_records", "row_numbers",
    "duplicated_values", "category_labels", "full_distribution",
)

# --- Fixed values: text that CSV intake reads as null (pandas defaults) -------
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Fixed values: patterns ---------------------------------------------------
DATE_TEXT_PATTERN = (
    r"^[1-9]\d{3}-\d{2}-\d{2}"
    r"([ T]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?)?$"
)
BLANK_PATTERN = r"(?U)^[\s\x1c-\x1f]*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
DECIMAL_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"
BOOLEAN_PATTERN = r"^(?i:true|false)$"
