"""Texts shown to reviewers: own wording, kept apart from the logic."""

ROUTE_REASONS = {
    "duplicate_key": "The statement speaks of repeated identifiers or keys.",
    "null_increase": "The statement speaks of nulls, blanks or empty fields.",
    "date_gap": "The statement speaks of absent dates, days or periods.",
    "category_shift": "The statement speaks of a moved category, status, segment or region.",
    "total_change": "The statement speaks of a changed total, sum, count or volume.",
    "schema_change": "The statement speaks of changed columns, fields or headers.",
    "general_suspected_issue": "No route term occurs in the statement.",
    "missing_issue_statement": "There is no statement, so no route can be chosen yet.",
}

REVIEW_PROMPTS = {
    "duplicate_key": (
        "Name the column or columns that make up the business key.",
        "Say whether a repeated identifier is ever allowed.",
    ),
    "null_increase": (
        "Name the fields that must be filled.",
        "Give the period or threshold behind the suspected rise in nulls.",
    ),
    "date_gap": (
        "State the date grain and the business calendar.",
        "Say whether weekends, holidays or late data should be left out.",
    ),
    "category_shift": (
        "Name the categorical fields that matter to the business.",
        "State the expected mix, the period compared and any planned change.",
    ),
    "total_change": (
        "Name the total, count or volume that moved.",
        "State the period compared and the tolerance.",
    ),
    "schema_change": (
        "State the expected schema and the required columns.",
        "Say whether an upstream schema change was planned.",
    ),
    "general_suspected_issue": (
        "Describe the suspected issue in concrete terms.",
        "State the business impact and the fields most likely involved.",
    ),
    "missing_issue_statement": (
        "Supply a statement of the known or suspected issue.",
    ),
}

# Checks asked of a person. Rules and routes share entries by key, so a check
# that both name is listed once.
HUMAN_CHECKS = {
    "key_columns": "Settle which column or columns form the business key.",
    "key_repeats": "Settle whether repeated identifiers are ever valid.",
    "key_source": "Look at source, extract and join changes behind higher repeat counts.",
    "key_nullable": "Settle whether key fields may be null here.",
    "null_columns": "Settle which columns the statement is about.",
    "null_upstream": "Look for changed validation, extraction or optional-field rules.",
    "null_matters": "Decide whether the null difference matters in operation.",
    "date_cadence": "Settle the expected cadence, above all whether it is daily.",
    "date_upstream": "Look for changed schedules, deliveries or filters.",
    "date_calendar": "Settle whether absent days are non-business days or real gaps.",
    "total_metric": "Settle which business metric the statement is about.",
    "total_expected": "Settle whether the row-count or total difference is expected.",
    "total_scope": "Compare filters, scope and aggregation of both snapshots.",
    "schema_contract": "Settle which columns are required and which are optional.",
    "schema_evolution": "Settle whether added or removed columns are planned.",
    "schema_downstream": "Look at downstream use before changing a contract.",
    "category_column": "Settle which categorical column the statement is about.",
    "category_matters": "Decide whether the change in unique counts matters.",
    "category_source": "Look for changed sources or mapping rules.",
    "general_clarify": "Make the statement clearer.",
    "general_profiles": "Use profile and comparison summaries to pick the next route.",
    "general_specific": "Write a more specific statement for the next run.",
    "general_profile_only": "Use the profile summary to pick the next route.",
    "general_baseline_only": "Use the comparison summary to pick the next route.",
}

ROUTE_CHECKS = {
    "duplicate_key": ("key_columns", "key_repeats", "key_source"),
    "null_increase": ("null_columns", "null_upstream", "null_matters"),
    "date_gap": ("date_cadence", "date_upstream", "date_calendar"),
    "total_change": ("total_metric", "total_expected", "total_scope"),
    "schema_change": ("schema_contract", "schema_evolution", "schema_downstream"),
    "category_shift": ("category_column", "category_matters", "category_source"),
    "general_suspected_issue": (
        "general_clarify", "general_profiles", "general_specific",
    ),
}

# Open points every case keeps: statement, reason, check.
OPEN_POINTS = (
    (
        "The cause is not determined.",
        "Aggregates do not show what changed upstream.",
        "Look at upstream extraction, transformation and business changes.",
    ),
    (
        "The business impact is not determined.",
        "Aggregates do not show impact or tolerance.",
        "Decide whether the signal matters in operation.",
    ),
    (
        "The expected behaviour is not determined.",
        "No rule, threshold or acceptance criterion is part of the data.",
        "Settle expected behaviour, thresholds and relevant columns.",
    ),
)

COMMON_LIMITATIONS = (
    "This is an aggregate signal only.",
    "It does not say why the signal appeared.",
    "A person must review it before acting on it.",
)
DAILY_LIMITATION = "A daily cadence is assumed and needs confirmation."

EVIDENCE_LIMITATIONS = (
    "No record, value or label is part of this item.",
    "The item does not say what caused the signal.",
    "A person must interpret the signal.",
)

CHECK_NAMES = {
    "duplicate_key_summary": "Repeated key values",
    "key_null_summary": "Nulls in keys",
    "current_null_summary": "Nulls in the current table",
    "date_range_summary": "Date range",
    "date_gap_summary": "Daily gaps",
    "numeric_total_summary": "Numeric totals",
    "row_count_summary": "Row count",
    "current_schema_summary": "Current schema",
    "categorical_shape_summary": "Category shape",
    "general_profile_signal_summary": "General profile",
    "baseline_duplicate_comparison": "Repeated keys against the baseline",
    "baseline_null_comparison": "Nulls against the baseline",
    "baseline_date_comparison": "Dates against the baseline",
    "baseline_total_comparison": "Totals and rows against the baseline",
    "baseline_schema_comparison": "Schema against the baseline",
    "baseline_category_shape_comparison": "Category shape against the baseline",
    "baseline_general_summary": "General comparison with the baseline",
}

# (text when the signal is present, text otherwise)
CHECK_SUMMARIES = {
    "duplicate_key_summary": (
        "A candidate key column repeats non-null values.",
        "No candidate key column repeats a non-null value.",
    ),
    "key_null_summary": (
        "A candidate key column holds nulls.",
        "No candidate key column holds a null.",
    ),
    "current_null_summary": (
        "Assessed columns hold nulls. Only a baseline can show an increase.",
        "Assessed columns hold no null. Only a baseline can show an increase.",
    ),
    "date_range_summary": (
        "Ranges of the parsed date columns were recorded.",
        "No candidate date column could be parsed.",
    ),
    "date_gap_summary": (
        "Days are absent inside the observed range, at a daily cadence.",
        "No day is absent inside the observed range, at a daily cadence.",
    ),
    "numeric_total_summary": (
        "Column totals were recorded. Only a baseline can show a change.",
        "No numeric column was available for totals.",
    ),
    "row_count_summary": (
        "The row count was recorded. Only a baseline can show a change.",
        "The row count was recorded.",
    ),
    "current_schema_summary": (
        "Schema metadata was recorded. Only a baseline can show a change.",
        "Schema metadata was recorded.",
    ),
    "categorical_shape_summary": (
        "Unique counts of category columns were recorded, without labels.",
        "No category-like column was available.",
    ),
    "general_profile_signal_summary": (
        "Overall profile counts were recorded.",
        "Overall profile counts were recorded.",
    ),
    "baseline_duplicate_comparison": (
        "A candidate key repeats more values than in the baseline.",
        "No candidate key repeats more values than in the baseline.",
    ),
    "baseline_null_comparison": (
        "A column has a higher null share than in the baseline.",
        "No column has a higher null share than in the baseline.",
    ),
    "baseline_date_comparison": (
        "A date column lacks a different number of days than the baseline.",
        "No date column lacks a different number of days than the baseline.",
    ),
    "baseline_total_comparison": (
        "A column total or the row count differs from the baseline.",
        "Column totals and the row count equal the baseline.",
    ),
    "baseline_schema_comparison": (
        "Columns or inferred kinds differ from the baseline.",
        "Columns and inferred kinds equal the baseline.",
    ),
    "baseline_category_shape_comparison": (
        "A category column has another unique count than the baseline.",
        "Category columns have the unique counts of the baseline.",
    ),
    "baseline_general_summary": (
        "Overall counts of both tables were compared.",
        "Overall counts of both tables were compared.",
    ),
}

NOT_RUN_REASONS = {
    "baseline_unavailable": "The check needs a baseline comparison this run does not have.",
    "needs_interpretation": "The check is a review a person does after the run.",
}

NO_EVIDENCE_RATIONALE = "No matching evidence item was available."
UNCLEAR_RATIONALE = "The matching evidence item was unclear."
BASELINE_ABSENT_RATIONALE = "No comparison with a baseline was available."

# Hypothesis rules per issue type, in order. kind: 'signal' and 'baseline' read
# one check; 'recorded' is supported as soon as any listed check ran; 'context'
# is always open. otherwise: status when the signal is absent.
HYPOTHESES = {
    "duplicate_key": (
        {
            "kind": "signal", "check_ids": ("duplicate_key_summary",),
            "otherwise": "not_supported_by_evidence",
            "statement": "Candidate keys repeat non-null values in the current table.",
            "checks": ("key_columns", "key_repeats"),
        },
        {
            "kind": "baseline", "check_ids": ("baseline_duplicate_comparison",),
            "otherwise": "not_supported_by_evidence",
            "statement": "Candidate keys repeat more values than in the baseline.",
            "checks": ("key_source",),
        },
        {
            "kind": "signal", "check_ids": ("key_null_summary",),
            "otherwise": "not_supported_by_evidence",
            "statement": "Nulls in candidate keys add to the concern.",
            "checks": ("key_nullable",),
        },
    ),
    "null_increase": (
        {
            "kind": "signal", "check_ids": ("current_null_summary",),
            "otherwise": "not_supported_by_evidence",
            "statement": "Assessed columns of the current table hold nulls.",
            "checks": ("null_columns",),
        },
        {
            "kind": "baseline", "check_ids": ("baseline_null_comparison",),
            "otherwise": "not_supported_by_evidence",
            "statement": "A column has a higher null share than in the baseline.",
            "checks": ("null_upstream",),
        },
        {
            "kind": "context", "check_ids": (), "otherwise": "unclear",
            "statement": "The concern may be about one particular column.",
            "rationale": "Null counts do not show which column was meant.",
            "checks": ("null_matters",),
        },
    ),
    "date_gap": (
        {
            "kind": "signal", "check_ids": ("date_gap_summary",),
            "otherwise": "not_supported_by_evidence",
            "statement": "Candidate date columns lack days at a daily cadence.",
            "checks": ("date_cadence",), "daily": True,
        },
        {
            "kind": "baseline", "check_ids": ("baseline_date_comparison",),
            "otherwise": "not_supported_by_evidence",
            "statement": "A date column lacks a different number of days than the baseline.",
            "checks": ("date_upstream",), "daily": True,
        },
        {
            "kind": "context", "check_ids": (), "otherwise": "unclear",
            "statement": "The daily cadence itself may not hold.",
            "rationale": "Daily counts do not show the right business calendar.",
            "checks": ("date_calendar",), "daily": True,
        },
    ),
    "total_change": (
        {
            "kind": "recorded",
            "check_ids": ("numeric_total_summary", "row_count_summary"),
            "otherwise": "not_assessed",
            "statement": "Current totals or row counts were recorded.",
            "checks": ("total_metric",),
        },
        {
            "kind": "baseline", "check_ids": ("baseline_total_comparison",),
            "otherwise": "not_supported_by_evidence",
            "statement": "Totals or row counts differ from the baseline.",
            "checks": ("total_expected",),
        },
        {
            "kind": "context", "check_ids": (), "otherwise": "unclear",
            "statement": "The change may hinge on the measure that was meant.",
            "rationale": "Totals do not show which measure was meant.",
            "checks": ("total_scope",),
        },
    ),
    "schema_change": (
        {
            "kind": "signal", "check_ids": ("current_schema_summary",),
            "otherwise": "not_assessed",
            "statement": "Metadata of the current schema was recorded.",
            "checks": ("schema_contract",),
        },
        {
            "kind": "baseline", "check_ids": ("baseline_schema_comparison",),
            "otherwise": "not_supported_by_evidence",
            "statement": "Columns or inferred kinds differ from the baseline.",
            "checks": ("schema_evolution",),
        },
        {
            "kind": "context", "check_ids": (), "otherwise": "unclear",
            "statement": "A schema difference needs a look at the contract.",
            "rationale": "Metadata does not show whether a difference was expected.",
            "checks": ("schema_downstream",),
        },
    ),
    "category_shift": (
        {
            "kind": "signal", "check_ids": ("categorical_shape_summary",),
            "otherwise": "unclear",
            "statement": "The shape of category columns was recorded without labels.",
            "checks": ("category_column",),
        },
        {
            "kind": "baseline", "check_ids": ("baseline_category_shape_comparison",),
            "otherwise": "not_supported_by_evidence",
            "statement": "The shape of category columns differs from the baseline.",
            "checks": ("category_source",),
        },
        {
            "kind": "context", "check_ids": (), "otherwise": "unclear",
            "statement": "A shift needs business context, as labels are left out.",
            "rationale": "Labels and shares per label are left out on purpose.",
            "checks": ("category_matters",),
        },
    ),
    "general_suspected_issue": (
        {
            "kind": "signal", "check_ids": ("general_profile_signal_summary",),
            "otherwise": "not_assessed",
            "statement": "Overall profile counts are worth a look.",
            "checks": ("general_profile_only",),
        },
        {
            "kind": "baseline", "check_ids": ("baseline_general_summary",),
            "otherwise": "not_supported_by_evidence",
            "statement": "Overall counts differ from the baseline.",
            "checks": ("general_baseline_only",),
        },
        {
            "kind": "context", "check_ids": (), "otherwise": "unclear",
            "statement": "The statement is too broad for one route.",
            "rationale": "A broad statement limits what rules can interpret.",
            "checks": ("general_specific",),
        },
    ),
}
