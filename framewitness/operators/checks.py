"""Evidence: what the route of a case finds in its table and its baseline.

A case meets the facts of its table as one array of column structs, so choosing
columns and evaluating checks is a projection over the case rows. No check
shuffles, groups or collects anything, however many cases there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.functions.expr import (
    array_of,
    contains_any,
    fold,
    most,
    pct,
    pick,
    quoted,
    struct_of,
    total,
    unnest,
)
from framewitness.functions.fixed import (
    CATEGORY_SHARE_LIMIT,
    CATEGORY_TERMS,
    DATE_TERMS,
    KEY_TERMS,
)
from framewitness.functions.wording import (
    CHECK_NAMES,
    CHECK_SUMMARIES,
    EVIDENCE_LIMITATIONS,
    NOT_RUN_REASONS,
)
from framewitness.operators.profile import table_measures
from framewitness.operators.routing import (
    MENTION_TYPES,
    candidate_rule,
    folded_names,
    mentions,
    reading_names,
    reading_words,
    route_rules,
)

_FACTS = (
    "position", "column_name AS name", "folded",
    "inferred_kind AS kind", "is_numeric_type AS is_number", "row_count",
    "null_count", "unique_count", "duplicate_value_count AS duplicates",
    "num_total", "day_min", "day_max", "dt_day_count AS days",
    "dt_expected_days AS expected_days", "dt_missing_days AS missing_days",
)

_METRIC = "STRUCT<name: STRING, value: DOUBLE, text: STRING, scalar: BOOLEAN>"
_ITEM = (
    "STRUCT<check_id: STRING, check_name: STRING, status: STRING, signal: STRING,"
    " signal_strength: STRING, summary: STRING, related_columns: ARRAY<STRING>,"
    f" metrics: ARRAY<{_METRIC}>, limitations: ARRAY<STRING>>"
)
_NO_ITEMS = f"CAST(array() AS ARRAY<{_ITEM}>)"


def table_facts(profile: DataFrame) -> DataFrame:
    """One row per table: its summary, and its columns in order as one array.

    A group holds one entry per column of one table; the profile is read once.
    """
    columns = f"array_sort(collect_list(struct({', '.join(_FACTS)})))"
    lowered = profile.withColumn("lowered", F.expr("lower(column_name)"))
    folded = lowered.withColumn("folded", F.expr(fold("lowered"))).drop("lowered")
    return folded.groupBy("dataset_id").agg(
        F.expr(columns).alias("columns"), *table_measures()
    )


# --- choosing columns ---------------------------------------------------------


def _assessed() -> str:
    """Columns a route looks at: its candidates, else its fallback."""

    def where(condition: str) -> str:
        return f"filter(columns, c -> {condition})"

    share = pct("c.unique_count", "c.row_count")
    category = (
        f"{contains_any('c.folded', CATEGORY_TERMS)}"
        f" OR (c.kind = 'text' AND {share} <= {CATEGORY_SHARE_LIMIT})"
    )
    dates = where("c.kind = 'datetime'")
    date_names = where(contains_any("c.folded", DATE_TERMS))
    chosen = "size(candidates) > 0"
    numbers = where("c.kind IN ('integer', 'decimal')")
    return f"""CASE
        WHEN issue_type = 'total_change'
            THEN filter(IF({chosen}, candidates, {numbers}), c -> c.is_number)
        WHEN {chosen} THEN candidates
        WHEN issue_type = 'duplicate_key' THEN {where(contains_any("c.folded", KEY_TERMS))}
        WHEN issue_type = 'null_increase' THEN columns
        WHEN issue_type = 'date_gap'
            THEN IF(size({dates}) > 0, {dates}, {date_names})
        WHEN issue_type = 'category_shift' THEN {where(category)}
        ELSE candidates END"""


# --- evidence items -----------------------------------------------------------


def _number(name: str, value: str) -> str:
    return struct_of(
        name=quoted(name),
        value=f"double({value})",
        text="CAST(NULL AS STRING)",
        scalar="true",
    )


def _words(name: str, text: str, *, scalar: bool = True) -> str:
    return struct_of(
        name=quoted(name),
        value="CAST(NULL AS DOUBLE)",
        text=f"string({text})",
        scalar="true" if scalar else "false",
    )


def _listing(name: str, value: str) -> str:
    """A metric that is a list or map: kept as JSON, never a scalar."""
    return _words(name, f"to_json({value})", scalar=False)


def _item(
    check_id: str,
    present: str,
    metrics: list[str],
    *,
    related: str | None = None,
    medium: str = "false",
    otherwise: str = "absent",
) -> str:
    found, none = CHECK_SUMMARIES[check_id]
    return struct_of(
        check_id=quoted(check_id),
        check_name=quoted(CHECK_NAMES[check_id]),
        status="'executed'",
        signal=f"IF({present}, 'present', {quoted(otherwise)})",
        signal_strength=f"IF({medium}, 'medium', 'low')",
        summary=f"IF({present}, {quoted(found)}, {quoted(none)})",
        related_columns=related or array_of(()),
        metrics=f"array({', '.join(metrics)})",
        limitations=array_of(EVIDENCE_LIMITATIONS),
    )


def _duplicate_items() -> list[str]:
    def one(check_id: str, field: str, counted: str, largest: str, share: str) -> str:
        affected = f"filter(assessed, c -> c.{field} > 0)"
        top = most(pick("assessed", field))
        present = f"size({affected}) > 0"
        return _item(
            check_id,
            present,
            [
                _number("candidate_column_count", "size(assessed)"),
                _number(counted, f"size({affected})"),
                _number(largest, top),
                _number(share, pct(top, "row_count")),
            ],
            related=pick(affected, "name"),
            medium=present,
        )

    return [
        one(
            "duplicate_key_summary",
            "duplicates",
            "columns_with_duplicate_non_null_values",
            "max_duplicate_value_count",
            "max_duplicate_value_percentage",
        ),
        one(
            "key_null_summary",
            "null_count",
            "columns_with_null_values",
            "max_null_count",
            "max_null_percentage",
        ),
    ]


def _null_items() -> list[str]:
    affected = "filter(assessed, c -> c.null_count > 0)"
    top = most(pick("assessed", "null_count"))
    present = f"size({affected}) > 0"
    return [
        _item(
            "current_null_summary",
            present,
            [
                _number("assessed_column_count", "size(assessed)"),
                _number("columns_with_nulls", f"size({affected})"),
                _number("max_null_count", top),
                _number("max_null_percentage", pct(top, "row_count")),
                _number("total_null_cells", total(pick("assessed", "null_count"))),
                _number("total_cells_assessed", "row_count * size(assessed)"),
            ],
            related=pick(affected, "name"),
            medium=present,
        )
    ]


def _date_items() -> list[str]:
    parsed = "filter(assessed, c -> c.day_min IS NOT NULL)"
    missing = total(pick(parsed, "missing_days"))
    metrics = [
        _number("assessed_date_column_count", "size(assessed)"),
        _number("parsed_date_column_count", f"size({parsed})"),
        _words("min_date", f"array_min({pick(parsed, 'day_min')})"),
        _words("max_date", f"array_max({pick(parsed, 'day_max')})"),
        _number("observed_unique_date_count", total(pick(parsed, "days"))),
        _number("expected_daily_date_count", total(pick(parsed, "expected_days"))),
        _number("missing_daily_period_count", missing),
    ]
    names = pick(parsed, "name")
    gap = f"{missing} > 0"
    return [
        _item(
            "date_range_summary",
            f"size({parsed}) > 0",
            metrics,
            related=names,
            otherwise="unclear",
        ),
        _item("date_gap_summary", gap, metrics, related=names, medium=gap),
    ]


def _total_items() -> list[str]:
    totals = pick("assessed", "num_total")
    return [
        _item(
            "numeric_total_summary",
            "size(assessed) > 0",
            [
                _number("assessed_numeric_column_count", "size(assessed)"),
                _number("numeric_columns_with_totals", "size(assessed)"),
                _number("min_column_total", f"round(array_min({totals}), 2)"),
                _number("max_column_total", f"round(array_max({totals}), 2)"),
            ],
            related=pick("assessed", "name"),
            otherwise="unclear",
        ),
        _item("row_count_summary", "true", [_number("row_count", "row_count")]),
    ]


def _schema_items() -> list[str]:
    kinds = f"array_sort(array_distinct({pick('columns', 'kind')}))"
    counts = f"""map_from_entries(transform({kinds},
        k -> struct(k, size(filter(columns, c -> c.kind = k)))))"""
    return [
        _item(
            "current_schema_summary",
            "true",
            [
                _number("column_count", "column_count"),
                _number("duplicate_column_name_count", "duplicate_column_name_count"),
                _number("empty_column_name_count", "empty_column_name_count"),
                _listing("inferred_kind_counts", counts),
                _number("candidate_column_count", "size(candidates)"),
            ],
            related=pick("candidates", "name"),
        )
    ]


def _category_items() -> list[str]:
    top = most(pick("assessed", "unique_count"))
    share = pct(top, "row_count")
    return [
        _item(
            "categorical_shape_summary",
            "size(assessed) > 0",
            [
                _number("assessed_categorical_column_count", "size(assessed)"),
                _number("columns_assessed_count", "size(assessed)"),
                _number("max_unique_count", top),
                _number("max_unique_percentage", share),
                _words(
                    "any_candidate_categorical_column_has_high_cardinality",
                    f"({share}) > {CATEGORY_SHARE_LIMIT}",
                ),
            ],
            related=pick("assessed", "name"),
            otherwise="unclear",
        )
    ]


def _general_items() -> list[str]:
    names = (
        "row_count", "column_count", "total_null_cells", "columns_with_nulls",
        "numeric_column_count", "datetime_column_count", "text_column_count",
        "duplicate_column_name_count", "empty_column_name_count",
    )
    metrics = [_number(name, name) for name in names]
    return [_item("general_profile_signal_summary", "true", metrics)]


def _baseline_items() -> dict[str, str]:
    """The one comparison item of each route."""

    def deltas(section: str) -> dict[str, str]:
        return {"related": pick(f"{section}.details", "column_name")}

    def listed(section: str) -> str:
        return _listing("column_deltas", f"{section}.details")

    more_duplicates = "duplicates.columns_higher > 0"
    more_nulls = "nulls.columns_higher > 0"
    other_days = "dates.columns_with_missing_delta > 0"
    other_total = "(numbers.columns_with_delta > 0 OR rows.delta <> 0)"
    other_names = "size(concat(schema.added_columns, schema.removed_columns)) > 0"
    other_unique = "categories.columns_with_delta > 0"
    general_names = (
        "row_count_delta", "column_count_delta", "total_null_cell_delta",
        "numeric_column_count_delta", "datetime_column_count_delta",
        "text_column_count_delta", "duplicate_column_name_count_delta",
        "empty_column_name_count_delta",
    )
    return {
        "duplicate_key": _item(
            "baseline_duplicate_comparison",
            more_duplicates,
            [
                _number("candidate_columns_compared", "duplicates.columns_compared"),
                _number(
                    "columns_with_higher_duplicate_count", "duplicates.columns_higher"
                ),
                _number("max_duplicate_count_delta", "duplicates.max_absolute_delta"),
                listed("duplicates"),
            ],
            medium=more_duplicates,
            **deltas("duplicates"),
        ),
        "null_increase": _item(
            "baseline_null_comparison",
            more_nulls,
            [
                _number("columns_compared", "nulls.columns_compared"),
                _number("columns_with_higher_null_percentage", "nulls.columns_higher"),
                _number("columns_with_lower_null_percentage", "nulls.columns_lower"),
                _number("max_null_percentage_delta", "nulls.max_absolute_delta"),
                listed("nulls"),
            ],
            medium=more_nulls,
            **deltas("nulls"),
        ),
        "date_gap": _item(
            "baseline_date_comparison",
            other_days,
            [
                _number("columns_compared", "dates.columns_compared"),
                _number("columns_with_range_change", "dates.columns_with_range_change"),
                _number(
                    "columns_with_missing_daily_period_delta",
                    "dates.columns_with_missing_delta",
                ),
                _words("daily_cadence_assumption", "true"),
                listed("dates"),
            ],
            medium=other_days,
            **deltas("dates"),
        ),
        "total_change": _item(
            "baseline_total_comparison",
            other_total,
            [
                _number("current_row_count", "rows.current"),
                _number("baseline_row_count", "rows.baseline"),
                _number("row_count_delta", "rows.delta"),
                _number("numeric_columns_compared", "numbers.columns_compared"),
                _number("columns_with_total_delta", "numbers.columns_with_delta"),
                _number("max_absolute_total_delta", "numbers.max_absolute_delta"),
                listed("numbers"),
            ],
            medium=other_total,
            **deltas("numbers"),
        ),
        "schema_change": _item(
            "baseline_schema_comparison",
            f"({other_names} OR schema.kind_change_count > 0)",
            [
                _number("current_column_count", "schema.current_column_count"),
                _number("baseline_column_count", "schema.baseline_column_count"),
                _listing("added_columns", "schema.added_columns"),
                _listing("removed_columns", "schema.removed_columns"),
                _number("shared_column_count", "schema.shared_column_count"),
                _number("inferred_kind_change_count", "schema.kind_change_count"),
                _listing("inferred_kind_changes", "schema.kind_changes"),
            ],
            related="concat(schema.added_columns, schema.removed_columns)",
            medium=other_names,
        ),
        "category_shift": _item(
            "baseline_category_shape_comparison",
            other_unique,
            [
                _number("columns_compared", "categories.columns_compared"),
                _number(
                    "columns_with_unique_count_delta", "categories.columns_with_delta"
                ),
                _number("max_unique_count_delta", "categories.max_absolute_delta"),
                _number(
                    "columns_with_high_cardinality_signal_delta",
                    "categories.columns_with_flag_delta",
                ),
                listed("categories"),
            ],
            medium=other_unique,
            **deltas("categories"),
        ),
        "general_suspected_issue": _item(
            "baseline_general_summary",
            "true",
            [_number(name, f"general.{name}") for name in general_names],
        ),
    }


_CURRENT_ITEMS = {
    "duplicate_key": _duplicate_items,
    "null_increase": _null_items,
    "date_gap": _date_items,
    "total_change": _total_items,
    "schema_change": _schema_items,
    "category_shift": _category_items,
    "general_suspected_issue": _general_items,
}


def _by_type(branches: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {quoted(t)} THEN {e}" for t, e in branches.items())
    return f"CASE issue_type {whens} ELSE {otherwise} END"


def with_shared(cases: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of cases with rows that many cases share.

    A plain equi-join: adaptive execution broadcasts the shared rows if their real size
    allows it, and otherwise splits the keys that very many cases have, null among them.
    """
    return cases.join(shared, keys, "left")


_CASE_KEYS = (
    "case_id", "issue_statement", "issue_type", "issue_provided", "dataset_id",
    "baseline_id",
)


def worded_cases(cases: DataFrame) -> DataFrame:
    """Classified cases with the words by which they may mention columns."""
    worded = reading_words(cases)
    kept = [c for c in _CASE_KEYS if c != "mentioned"]
    return worded.select(*kept, "sentence", "issue_tokens")


def mentioned_columns(worded: DataFrame, names: DataFrame) -> DataFrame:
    """One row per table and sentence that mentions columns, with their positions.

    ``names`` has dataset_id, position and the folded name of each column.
    """
    return (
        mentions(reading_names(worded), names)
        .groupBy("dataset_id", "sentence")
        .agg(F.array_sort(F.collect_set("position")).alias("found"))
    )


def with_mentioned(worded: DataFrame, found: DataFrame, *kept: str) -> DataFrame:
    """Everything that the evidence of a case depends on, ``mentioned`` among it."""
    listed = ", ".join(quoted(t) for t in MENTION_TYPES)
    joined = with_shared(worded, found, ["dataset_id", "sentence"])
    mentioned = F.expr(
        f"IF(issue_type IN ({listed}) AND found IS NOT NULL, found, CAST(array() AS ARRAY<INT>))"
    )
    keys = [c for c in _CASE_KEYS if c in worded.columns]
    return joined.select(*keys, mentioned.alias("mentioned"), *kept)


def case_keys(cases: DataFrame, facts: DataFrame) -> DataFrame:
    """Classified cases with everything their evidence depends on.

    That is the issue type, the table, the baseline and, for the two types that
    read column names from the statement, the columns it mentions; the facts of
    the table come along.
    """
    names = facts.selectExpr("dataset_id", "explode(columns) AS c").selectExpr(
        "dataset_id", "c.position", "c.folded"
    )
    worded = worded_cases(cases)
    found = mentioned_columns(worded, names)
    kept = [c for c in facts.columns if c != "dataset_id"]
    return with_mentioned(with_shared(worded, facts, ["dataset_id"]), found, *kept)


def evaluate(
    keyed: DataFrame,
    facts: DataFrame | None,
    comparison: DataFrame | None = None,
) -> DataFrame:
    """Adds the evidence items and the checks not run to every row of ``keyed``.

    ``facts`` is None where ``keyed`` has them already.
    """
    rules = F.broadcast(route_rules(keyed.sparkSession))
    joined = keyed.join(rules, "issue_type")
    if facts is not None:
        joined = with_shared(joined, facts, ["dataset_id"])
    current = {t: f"array({', '.join(b())})" for t, b in _CURRENT_ITEMS.items()}
    if comparison is None:
        nothing = F.lit(None).cast("bigint")
        joined = joined.withColumns(
            {
                "has_baseline": F.lit(False),
                "baseline_row_count": nothing,
                "baseline_column_count": nothing,
            }
        )
        baseline = _NO_ITEMS
    else:
        sections = comparison.withColumnRenamed("current_id", "dataset_id")
        keys = ["dataset_id", "baseline_id"]
        joined = with_shared(joined, sections, keys)
        joined = joined.withColumns(
            {
                "has_baseline": F.expr("rows IS NOT NULL"),
                "baseline_row_count": F.expr("rows.baseline"),
                "baseline_column_count": F.expr("column_counts.baseline"),
            }
        )
        compared = _by_type(_baseline_items(), "NULL")
        baseline = f"IF(has_baseline, array({compared}), {_NO_ITEMS})"
    rule = candidate_rule(
        "c.folded", "c.kind", "array_contains(mentioned, c.position)"
    )
    items = f"concat({_by_type(current, _NO_ITEMS)}, {baseline})"
    fields = (
        "check_id", "check_name", "status", "signal", "signal_strength", "summary",
        "related_columns", "metrics", "limitations",
    )
    numbered = struct_of(
        evidence_id="format_string('ev-%03d', i + 1)", **{f: f"e.{f}" for f in fields}
    )
    return (
        joined.withColumn("has_data", F.expr("columns IS NOT NULL"))
        .withColumn("candidates", F.expr(f"filter(columns, c -> {rule})"))
        .withColumn("assessed", F.expr(_assessed()))
        .withColumn(
            "items", F.expr(f"IF(issue_provided AND has_data, {items}, {_NO_ITEMS})")
        )
        .withColumn("evidence", F.expr(f"transform(items, (e, i) -> {numbered})"))
        .withColumn("checks_not_run", F.expr(_not_run()))
        .select(
            *[c for c in (*_CASE_KEYS, "mentioned", "outcome_key") if c in keyed.columns],
            "route_name",
            "has_data",
            "has_baseline",
            "row_count",
            "column_count",
            "baseline_row_count",
            "baseline_column_count",
            F.expr(pick("candidates", "name")).alias("candidate_columns"),
            "planned_checks",
            "evidence",
            "checks_not_run",
            "hypothesis_rules",
            "route_checks",
        )
    )


def case_evidence(
    cases: DataFrame,
    facts: DataFrame,
    comparison: DataFrame | None = None,
) -> DataFrame:
    """One row per case with its evidence items and the checks not run.

    ``facts`` has one row per table and ``comparison`` one row per pair.
    """
    return evaluate(case_keys(cases, facts), None, comparison)


def _not_run() -> str:
    code = "IF(p.requires_baseline, 'baseline_unavailable', 'needs_interpretation')"
    reasons = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in NOT_RUN_REASONS.items())
    ran = f"array_contains({pick('items', 'check_id')}, p.executed_as)"
    row = struct_of(
        check_id="p.check_id",
        reason_code=code,
        reason=f"map({reasons})[{code}]",
    )
    kept = f"filter(planned_checks, p -> NOT coalesce({ran}, false))"
    return f"IF(has_data, transform({kept}, p -> {row}), filter(array({_EMPTY_ROW}), x -> false))"


_EMPTY_ROW = struct_of(check_id="''", reason_code="''", reason="''")


# --- tables -------------------------------------------------------------------


def evidence_ledger(case_files: DataFrame) -> DataFrame:
    """One row per evidence item."""
    return unnest(case_files, "evidence", "evidence_id", "case_id", "issue_type")


def evidence_metrics(case_files: DataFrame) -> DataFrame:
    """One row per metric of an evidence item, in order."""
    return unnest(case_files, "evidence", "evidence_id", "case_id").selectExpr(
        "case_id", "evidence_id", "check_id", "posexplode(metrics) AS (pos, m)"
    ).selectExpr(
        "case_id", "evidence_id", "check_id", "pos + 1 AS ordinal", "m.name AS metric",
        "m.value", "m.text", "m.scalar",
    )


def checks_not_run(case_files: DataFrame) -> DataFrame:
    return unnest(case_files, "checks_not_run", "check_id", "case_id")


def ledger_execution(reviewed: DataFrame) -> DataFrame:
    """Execution counters of every case that has a table."""
    return reviewed.filter("has_data").selectExpr(
        "case_id",
        "IF(issue_provided, 'checks_executed', 'not_executed') AS status",
        "counts.checks_executed AS checks_executed_count",
        "counts.evidence AS evidence_item_count",
        "counts.not_run AS checks_not_run_count",
        "has_baseline AS baseline_available",
    )
