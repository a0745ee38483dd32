"""Every registered query. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewitness.catalog import inputs
from framewitness.functions.expr import quoted
from framewitness.functions.fixed import HYPOTHESIS_STATUSES, KEY_TERMS
from framewitness.operators import checks, compare, notes, profile, review
from framewitness.operators import routing, runs, safety, sketches
from framewitness.plans import Investigation, investigate
from framewitness.sources.tables import Table, table_sources, type_inference

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# How to release what the query before kept; its result stays usable, as Spark works it
# out again. One query's frames are kept at a time, and no result of another is reused.
_BEFORE: list[Callable[[], object]] = []


def _release(closing: Callable[[], object]) -> None:
    while _BEFORE:
        _BEFORE.pop()()
    _BEFORE.append(closing)


def _kept(df: DataFrame) -> DataFrame:
    kept = df.persist()
    _release(kept.unpersist)
    return kept


def _also_kept(df: DataFrame) -> DataFrame:
    """Kept besides what the query has kept before."""
    kept = df.persist()
    _BEFORE.append(kept.unpersist)
    return kept


def _joined(array: str) -> str:
    return f"array_join({array}, ',')"


def _key_names(table: Table) -> list[str]:
    return [n for n in table.names if any(t in n.lower() for t in KEY_TERMS)]


# --- sources ------------------------------------------------------------------


@query
def src_row_counts(spark, sf):
    shapes = [inputs.table(spark, sf, name).shape() for name in inputs.TABLE_NAMES]
    return reduce(DataFrame.unionByName, shapes).selectExpr(
        "dataset_id AS table_name", "row_count"
    )


@query
def dataset_shape(spark, sf):
    return inputs.table(spark, sf, "orders").shape().select("row_count", "column_count")


@query
def intake_type_inference(spark, sf):
    found = []
    for name in ("customer", "documents"):
        rows = inputs.rows(spark, sf, name)
        text = rows.selectExpr(*[f"string({c}) AS {c}" for c in rows.columns])
        found.append(type_inference(Table.of(text, name)).drop("position"))
    return found[0].unionByName(found[1])


# --- profile ------------------------------------------------------------------


@query
def profile_nulls(spark, sf):
    now, _ = inputs.labelled_documents(spark, sf)
    return profile.column_profile(now, measures=("nulls",)).select(
        "column_name", "row_count", "non_null_count", "null_count", "null_percentage"
    )


@query
def profile_unique(spark, sf):
    lineitem = inputs.table(spark, sf, "lineitem")
    return profile.column_profile(lineitem, measures=("unique",)).select(
        "column_name", "non_null_count", "unique_count", "unique_percentage"
    )


@query
def profile_duplicates(spark, sf):
    lineitem = inputs.table(spark, sf, "lineitem")
    return profile.column_profile(lineitem, measures=("unique",)).select(
        "column_name", "non_null_count", "unique_count", "duplicate_value_count"
    )


def _dated_profiles(spark, sf) -> DataFrame:
    tables = [inputs.table(spark, sf, "events"), inputs.orders_with_date_text(spark, sf)]
    return profile.profiles(tables, measures=("nulls", "dates"))


@query
def profile_kinds(spark, sf):
    return _dated_profiles(spark, sf).select(
        "dataset_id", "column_name", "inferred_kind"
    )


@query
def profile_kind_counts(spark, sf):
    return profile.kind_counts(_dated_profiles(spark, sf))


@query
def profile_numeric(spark, sf):
    part = profile.column_profile(
        inputs.table(spark, sf, "part"), measures=("numeric",)
    )
    return part.filter("inferred_kind IN ('integer', 'decimal')").selectExpr(
        "column_name",
        "num_min",
        "num_max",
        "round(num_mean, 2) AS num_mean",
        "round(num_total, 2) AS num_total",
    )


@query
def profile_datetime(spark, sf):
    return _dated_profiles(spark, sf).filter("inferred_kind = 'datetime'").select(
        "dataset_id", "column_name", "dt_parsed_count", "dt_parse_percentage",
        "dt_min", "dt_max", "dt_day_count", "dt_expected_days", "dt_missing_days",
    )


@query
def profile_long_dates(spark, sf):
    # The kind of a text may depend neither on its length nor on what else is asked.
    pattern = f"yyyy/MM/dd'{inputs.LONG_DATE_TAIL}'"
    found = []
    for measures in (("dates",), ("unique", "dates")):
        dated = profile.column_profile(
            inputs.orders_with_long_dates(spark, sf),
            measures=measures,
            date_formats=(pattern,),
        )
        found.append(dated.filter("column_name = 'received'").withColumn(
            "asked", F.lit(",".join(measures))
        ))
    return found[0].unionByName(found[1]).select(
        "asked", "inferred_kind", "dt_parsed_count", "dt_min", "dt_max",
        "dt_day_count", "dt_missing_days",
    )


@query
def profile_big_integers(spark, sf):
    found = []
    for measures in (("numeric",), ("unique", "numeric")):
        exact = profile.column_profile(inputs.big_numbers(spark, sf), measures=measures)
        found.append(exact.withColumn("asked", F.lit(",".join(measures))))
    return found[0].unionByName(found[1]).select(
        "asked", "column_name", "num_min_exact", "num_max_exact", "num_total_exact"
    )


# How each table is cut into an older and a newer half that add up.
_HALVES = {
    "lineitem": "l_orderkey % 2 = 0",
    "events": "event_id % 3 = 0",
    "documents": "doc_id % 2 = 0",
}


@query
def profile_sketches(spark, sf):
    """Merged states of two halves of each table, next to the exact unique counts."""
    states = []
    for name, condition in _HALVES.items():
        frame = inputs.rows(spark, sf, name)
        for half in (condition, f"NOT ({condition})"):
            states.append(sketches.state(Table.of(frame.filter(half), name, columnar=True)))
    merged = sketches.finished(sketches.merged(states))
    tables = [inputs.table(spark, sf, name) for name in _HALVES]
    exact = profile.profiles(tables, measures=("unique",)).selectExpr(
        "dataset_id", "position", "unique_count AS exact_count"
    )
    error = sketches.unique_error()
    return merged.join(exact, ["dataset_id", "position"]).selectExpr(
        "dataset_id",
        "column_name",
        "inferred_kind",
        "row_count",
        "null_count",
        "exact_count AS unique_count",
        f"abs(unique_count - exact_count) <= {error} * exact_count AS within_bound",
        "num_min",
        "num_max",
        "dt_min",
        "dt_max",
        "dt_day_count",
        "dt_missing_days",
        "txt_min_len",
        "txt_max_len",
    )


@query
def profile_text_length(spark, sf):
    documents = profile.column_profile(
        inputs.table(spark, sf, "documents"), measures=("text",)
    )
    return documents.filter("inferred_kind = 'text'").selectExpr(
        "column_name",
        "txt_min_len",
        "txt_max_len",
        "round(txt_avg_len, 2) AS txt_avg_len",
    )


@query
def profile_duplicate_names(spark, sf):
    # An export whose header repeats one name and leaves two blank.
    names = ("id", "customer", "id", "", "status", " ")
    export = inputs.rows(spark, sf, "orders").selectExpr(
        "o_orderkey a", "o_custkey b", "o_orderkey c", "o_totalprice d",
        "o_orderstatus e", "o_orderdate f",
    )
    table = Table.of(export, "export", names, columnar=True)
    found = profile.duplicate_names(profile.column_profile(table, measures=("nulls",)))
    return found.select("column_name", "occurrences", "is_empty_name", "non_null_count")


def _whole_profile(table: Table) -> DataFrame:
    return profile.column_profile(table).selectExpr(
        "position", "column_name", "inferred_kind", "row_count", "non_null_count",
        "null_count", "null_percentage", "unique_count", "unique_percentage",
        "duplicate_value_count", "num_min", "num_max", "round(num_mean, 2) AS num_mean",
        "round(num_total, 2) AS num_total",
        "double(dt_parsed_count) AS dt_parsed_count", "dt_parse_percentage",
        "dt_min", "dt_max", "day_min", "day_max",
        "double(dt_day_count) AS dt_day_count",
        "double(dt_expected_days) AS dt_expected_days",
        "double(dt_missing_days) AS dt_missing_days",
        "double(txt_min_len) AS txt_min_len", "double(txt_max_len) AS txt_max_len",
        "round(txt_avg_len, 2) AS txt_avg_len",
    )


@query
def profile_table_lineitem(spark, sf):
    return _whole_profile(inputs.table(spark, sf, "lineitem"))


@query
def profile_table_events(spark, sf):
    return _whole_profile(inputs.table(spark, sf, "events"))


@query
def profile_table_docs(spark, sf):
    return _whole_profile(inputs.labelled_documents(spark, sf)[0])


# --- routing ------------------------------------------------------------------


@query
def route_issues(spark, sf):
    return routing.route(inputs.issue_cases(spark, sf)).select(
        "case_id", "issue_type", "route_name", "classification_status"
    )


@query
def route_matched_terms(spark, sf):
    routed = routing.classify(inputs.issue_cases(spark, sf)).selectExpr(
        "coalesce(issue_statement, '(none)') AS statement",
        "issue_type",
        f"{_joined('matched_terms')} AS terms",
    )
    return routed.groupBy("statement", "issue_type", "terms").agg(
        F.expr("count(1)").alias("case_count")
    )


@query
def route_issue_tokens(spark, sf):
    routed = routing.classify(inputs.issue_cases(spark, sf)).selectExpr(
        "coalesce(issue_statement, '(none)') AS statement",
        f"{_joined('array_sort(issue_tokens)')} AS tokens",
    )
    return routed.groupBy("statement", "tokens").agg(
        F.expr("count(1)").alias("case_count")
    )


_ROUTED = (
    "issue_type",
    "route_name",
    "classification_status",
    f"{_joined('matched_terms')} AS terms",
    "size(issue_tokens) AS token_count",
    "md5(issue_phrase) AS tokens_md5",
)


@query
def route_documents(spark, sf):
    """Every whole document as a statement."""
    cases = inputs.rows(spark, sf, "documents").selectExpr(
        "doc_id", "text AS issue_statement", "source", "lang"
    )
    return routing.route(cases).selectExpr("doc_id", *_ROUTED)


@query
def route_conversations(spark, sf):
    """Every turn as a statement."""
    cases = inputs.rows(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "text AS issue_statement"
    )
    return routing.route(cases).selectExpr("conv_id", "turn", *_ROUTED)


@query
def route_marked_texts(spark, sf):
    """Documents and turns with issues planted into most of them."""
    return routing.route(inputs.marked_texts(spark, sf)).selectExpr("case_id", *_ROUTED)


@query
def candidate_columns_texts(spark, sf):
    kinds = _kept(profile.profiles(_case_tables(spark, sf), measures=("nulls", "dates")))
    found = routing.candidate_columns(inputs.marked_texts(spark, sf), kinds, keep=_also_kept)
    return found.select("case_id", "dataset_id", "issue_type", "position", "column_name")


def _case_tables(spark, sf) -> list[Table]:
    return [
        *inputs.orders_by_date(spark, sf),
        *inputs.labelled_documents(spark, sf),
        *inputs.parties(spark, sf),
    ]


@query
def candidate_columns(spark, sf):
    kinds = _kept(profile.profiles(_case_tables(spark, sf), measures=("nulls", "dates")))
    found = routing.candidate_columns(inputs.issue_cases(spark, sf), kinds, keep=_also_kept)
    return found.groupBy("dataset_id", "issue_type", "position", "column_name").agg(
        F.expr("count(1)").alias("case_count")
    )


@query
def planned_checks(spark, sf):
    keys = [
        "issue_type", "baseline_available", "check_ordinal", "check_id",
        "requires_baseline", "requires_raw_dataset", "requires_dataset_profile",
        "executable", "stage",
    ]
    planned = routing.planned_checks(routing.route(inputs.issue_cases(spark, sf)))
    return planned.groupBy(*keys).agg(F.expr("count(1)").alias("case_count"))


@query
def review_prompts(spark, sf):
    routed = routing.route(inputs.issue_cases(spark, sf))
    prompts = routed.selectExpr("issue_type", "posexplode(review_prompts) AS (p, t)")
    return prompts.groupBy(
        "issue_type", F.expr("p + 1").alias("prompt_ordinal")
    ).agg(F.expr("count(1)").alias("case_count"))


@query
def plan_inputs(spark, sf):
    plans = routing.plan_inputs(routing.route(inputs.issue_cases(spark, sf)))
    return plans.groupBy(
        "issue_type",
        "baseline_available",
        F.expr(_joined("available_inputs")).alias("available"),
        F.expr(_joined("missing_inputs")).alias("missing"),
    ).agg(F.expr("count(1)").alias("case_count"))


# --- current-table checks -----------------------------------------------------


def _one_case(spark, statement: str, dataset_id: str, baseline_id: str | None = None):
    return spark.range(1).selectExpr(
        "id AS case_id",
        f"{quoted(statement)} AS issue_statement",
        f"{quoted(dataset_id)} AS dataset_id",
        f"{quoted(baseline_id)} AS baseline_id",
    )


def _number(metric: str, name: str, type_: str = "BIGINT") -> str:
    found = f"filter(metrics, m -> m.name = {quoted(metric)})[0].value"
    return f"CAST({found} AS {type_}) AS {name}"


def _text(metric: str, name: str) -> str:
    return f"filter(metrics, m -> m.name = {quoted(metric)})[0].text AS {name}"


_SIGNAL = ("check_id", "signal", "signal_strength")
_RELATED = f"{_joined('related_columns')} AS related_columns"


def _current_check(spark, table, statement, check_id, outputs, **options) -> DataFrame:
    facts = checks.table_facts(profile.column_profile(table, **options))
    case = _one_case(spark, statement, table.dataset_id)
    evidence = checks.case_evidence(case, facts)
    ledger = checks.evidence_ledger(evidence)
    return ledger.filter(F.col("check_id") == check_id).selectExpr(*_SIGNAL, *outputs)


@query
def check_duplicate_keys(spark, sf):
    lineitem = inputs.table(spark, sf, "lineitem")
    return _current_check(
        spark,
        lineitem,
        "Keys keep repeating",
        "duplicate_key_summary",
        [
            _number("candidate_column_count", "candidate_column_count"),
            _number("columns_with_duplicate_non_null_values", "affected_columns"),
            _number("max_duplicate_value_count", "max_count"),
            _number("max_duplicate_value_percentage", "max_percentage", "DOUBLE"),
            _RELATED,
        ],
        columns=_key_names(lineitem),
        measures=("unique",),
    )


@query
def check_key_nulls(spark, sf):
    lineitem = inputs.table(spark, sf, "lineitem")
    return _current_check(
        spark,
        lineitem,
        "Keys keep repeating",
        "key_null_summary",
        [
            _number("candidate_column_count", "candidate_column_count"),
            _number("columns_with_null_values", "affected_columns"),
            _number("max_null_count", "max_count"),
            _number("max_null_percentage", "max_percentage", "DOUBLE"),
            _RELATED,
        ],
        columns=_key_names(lineitem),
        measures=("nulls",),
    )


@query
def check_current_nulls(spark, sf):
    now, _ = inputs.labelled_documents(spark, sf)
    return _current_check(
        spark,
        now,
        "More nulls than usual",
        "current_null_summary",
        [
            _number("assessed_column_count", "assessed"),
            _number("columns_with_nulls", "with_nulls"),
            _number("max_null_count", "max_null_count"),
            _number("max_null_percentage", "max_null_percentage", "DOUBLE"),
            _number("total_null_cells", "total_null_cells"),
            _number("total_cells_assessed", "total_cells"),
            _RELATED,
        ],
        measures=("nulls",),
    )


_DATE_OUTPUTS = [
    _number("assessed_date_column_count", "assessed"),
    _number("parsed_date_column_count", "parsed"),
    _text("min_date", "min_date"),
    _text("max_date", "max_date"),
    _number("observed_unique_date_count", "observed_days"),
    _number("expected_daily_date_count", "expected_days"),
    _number("missing_daily_period_count", "missing_days"),
    _RELATED,
]


@query
def check_date_range(spark, sf):
    orders = inputs.table(spark, sf, "orders")
    return _current_check(
        spark, orders, "There is a gap", "date_range_summary", _DATE_OUTPUTS,
        measures=("dates",),
    )


@query
def check_date_gaps(spark, sf):
    orders = inputs.table(spark, sf, "orders")
    return _current_check(
        spark, orders, "There is a gap", "date_gap_summary", _DATE_OUTPUTS,
        measures=("dates",),
    )


@query
def check_numeric_totals(spark, sf):
    orders = inputs.table(spark, sf, "orders")
    return _current_check(
        spark,
        orders,
        "The total looks low",
        "numeric_total_summary",
        [
            _number("assessed_numeric_column_count", "assessed"),
            _number("numeric_columns_with_totals", "with_totals"),
            _number("min_column_total", "min_total", "DOUBLE"),
            _number("max_column_total", "max_total", "DOUBLE"),
            _RELATED,
        ],
        measures=("numeric",),
    )


@query
def check_row_count(spark, sf):
    orders = inputs.table(spark, sf, "orders")
    return _current_check(
        spark, orders, "The total looks low", "row_count_summary",
        [_number("row_count", "row_count")], measures=(),
    )


@query
def check_schema(spark, sf):
    customer = inputs.table(spark, sf, "customer")
    kinds = "filter(metrics, m -> m.name = 'inferred_kind_counts')[0].text"

    def kind(name: str) -> str:
        return (
            f"coalesce(bigint(get_json_object({kinds}, '$.{name}')), 0L)"
            f" AS {name}_columns"
        )

    return _current_check(
        spark,
        customer,
        "The header changed for acctbal",
        "current_schema_summary",
        [
            _number("column_count", "column_count"),
            _number("duplicate_column_name_count", "duplicate_names"),
            _number("empty_column_name_count", "empty_names"),
            _number("candidate_column_count", "candidate_columns"),
            *[kind(k) for k in ("integer", "decimal", "datetime", "text", "boolean")],
            _RELATED,
        ],
        measures=("nulls", "dates"),
    )


@query
def check_category_shape(spark, sf):
    orders = inputs.table(spark, sf, "orders")
    return _current_check(
        spark,
        orders,
        "The mix changed",
        "categorical_shape_summary",
        [
            _number("assessed_categorical_column_count", "assessed"),
            _number("max_unique_count", "max_unique"),
            _number("max_unique_percentage", "max_unique_percentage", "DOUBLE"),
            _text(
                "any_candidate_categorical_column_has_high_cardinality",
                "high_cardinality",
            ),
            _RELATED,
        ],
        measures=("unique", "dates"),
    )


@query
def check_general_profile(spark, sf):
    now, _ = inputs.labelled_documents(spark, sf)
    names = (
        "row_count", "column_count", "total_null_cells", "columns_with_nulls",
        "numeric_column_count", "datetime_column_count", "text_column_count",
        "duplicate_column_name_count", "empty_column_name_count",
    )
    return _current_check(
        spark, now, "Something feels off", "general_profile_signal_summary",
        [_number(n, n) for n in names], measures=("nulls", "dates"),
    )


# --- comparison ---------------------------------------------------------------


def _compared(spark, sides: tuple[Table, Table], **options) -> DataFrame:
    current, baseline = sides
    pair = spark.range(1).selectExpr(
        f"{quoted(current.dataset_id)} AS current_id",
        f"{quoted(baseline.dataset_id)} AS baseline_id",
    )
    return compare.compare(profile.profiles(sides, **options), pair)


def _comparison_of_orders(spark, sf, *measures: str, **options) -> DataFrame:
    sides = inputs.orders_by_date(spark, sf)
    return _compared(spark, sides, measures=measures, **options)


def _comparison_of_documents(spark, sf) -> DataFrame:
    return _compared(spark, inputs.labelled_documents(spark, sf), measures=("nulls",))


def _comparison_of_parties(spark, sf) -> DataFrame:
    return _compared(spark, inputs.parties(spark, sf), measures=("nulls", "dates"))


def _comparison_of_events(spark, sf) -> DataFrame:
    sides = inputs.events_without_errors(spark, sf)
    return _compared(spark, sides, measures=("unique", "dates"))


def _comparison_of_deliveries(spark, sf) -> DataFrame:
    sides = inputs.redelivered_orders(spark, sf)
    return _compared(
        spark, sides, columns=_key_names(sides[0]), measures=("unique",)
    )


def _plain(df: DataFrame) -> DataFrame:
    return df.drop("current_id", "baseline_id")


@query
def cmp_row_count(spark, sf):
    compared = _comparison_of_orders(spark, sf)
    return compared.selectExpr("current_id", "baseline_id", "rows.*")


@query
def cmp_sources(spark, sf):
    """Where both sides of a comparison come from, and their shape."""
    sides = inputs.orders_by_date(spark, sf)
    other = inputs.table(spark, sf, "customer"), inputs.parties(spark, sf)[1]
    compared = [
        compare.with_sources(
            _compared(spark, pair, measures=("nulls",)), table_sources(spark, pair)
        )
        for pair in (sides, other)
    ]
    return reduce(DataFrame.unionByName, map(compare.source_rows, compared)).selectExpr(
        "* EXCEPT (baseline_name)", "coalesce(baseline_name, '(none)') AS baseline_name"
    )


@query
def cmp_column_count(spark, sf):
    return _comparison_of_parties(spark, sf).selectExpr(
        "rows.current AS current_rows",
        "rows.baseline AS baseline_rows",
        "column_counts.*",
    )


def _schema_row(compared: DataFrame) -> DataFrame:
    return compared.selectExpr(
        "schema.current_column_count",
        "schema.baseline_column_count",
        f"{_joined('schema.added_columns')} AS added",
        f"{_joined('schema.removed_columns')} AS removed",
        "schema.shared_column_count AS shared_count",
        "schema.kind_change_count",
        "schema.current_duplicate_names",
        "schema.baseline_duplicate_names",
        "schema.current_empty_names",
        "schema.baseline_empty_names",
    )


def _comparison_of_widths(spark, sf) -> DataFrame:
    return _compared(spark, inputs.wide_and_narrow(spark, sf), measures=("nulls", "dates"))


@query
def cmp_schema(spark, sf):
    return _schema_row(_comparison_of_parties(spark, sf))


@query
def cmp_schema_wide(spark, sf):
    return _schema_row(_comparison_of_widths(spark, sf))


@query
def cmp_kind_changes(spark, sf):
    return _plain(compare.details(_comparison_of_parties(spark, sf), "kind_changes"))


@query
def cmp_nulls(spark, sf):
    return _plain(compare.details(_comparison_of_documents(spark, sf), "nulls"))


@query
def cmp_nulls_summary(spark, sf):
    return _plain(compare.summary(_comparison_of_documents(spark, sf), "nulls"))


@query
def cmp_numeric(spark, sf):
    compared = _comparison_of_orders(spark, sf, "numeric")
    return _plain(compare.details(compared, "numbers"))


@query
def cmp_numeric_summary(spark, sf):
    compared = _comparison_of_orders(spark, sf, "numeric")
    return _plain(compare.summary(compared, "numbers"))


@query
def cmp_dates(spark, sf):
    compared = _comparison_of_orders(spark, sf, "dates")
    return _plain(compare.details(compared, "dates"))


@query
def cmp_category_shape(spark, sf):
    return _plain(compare.details(_comparison_of_events(spark, sf), "categories"))


@query
def cmp_duplicates(spark, sf):
    return _plain(compare.details(_comparison_of_deliveries(spark, sf), "duplicates"))


@query
def cmp_general(spark, sf):
    return _comparison_of_parties(spark, sf).selectExpr("general.*")


_SIGNALS = ("rows.delta AS row_delta", "signal_count", "compared_column_count")


@query
def cmp_signal_count(spark, sf):
    return _comparison_of_parties(spark, sf).selectExpr(*_SIGNALS)


@query
def cmp_signal_count_wide(spark, sf):
    return _comparison_of_widths(spark, sf).selectExpr(*_SIGNALS)


# --- baseline evidence --------------------------------------------------------


def _baseline_check(spark, sides, statement, check_id, outputs, **options) -> DataFrame:
    current, baseline = sides
    # Two readers of one profile, one row per column, which is kept between them.
    staged = _kept(profile.profiles(sides, **options))
    pair = spark.range(1).selectExpr(
        f"{quoted(current.dataset_id)} AS current_id",
        f"{quoted(baseline.dataset_id)} AS baseline_id",
    )
    compared = compare.compare(staged, pair)
    case = _one_case(spark, statement, current.dataset_id, baseline.dataset_id)
    evidence = checks.case_evidence(case, checks.table_facts(staged), compared)
    ledger = checks.evidence_ledger(evidence)
    return ledger.filter(F.col("check_id") == check_id).selectExpr(
        *_SIGNAL, _RELATED, *outputs
    )


@query
def ev_baseline_duplicates(spark, sf):
    sides = inputs.redelivered_orders(spark, sf)
    return _baseline_check(
        spark,
        sides,
        "Keys keep repeating",
        "baseline_duplicate_comparison",
        [
            _number("candidate_columns_compared", "columns_compared"),
            _number("columns_with_higher_duplicate_count", "columns_higher"),
            _number("max_duplicate_count_delta", "max_delta"),
        ],
        columns=_key_names(sides[0]),
        measures=("unique",),
    )


@query
def ev_baseline_nulls(spark, sf):
    return _baseline_check(
        spark,
        inputs.labelled_documents(spark, sf),
        "More nulls than usual",
        "baseline_null_comparison",
        [
            _number("columns_compared", "columns_compared"),
            _number("columns_with_higher_null_percentage", "columns_higher"),
            _number("columns_with_lower_null_percentage", "columns_lower"),
            _number("max_null_percentage_delta", "max_delta", "DOUBLE"),
        ],
        measures=("nulls",),
    )


@query
def ev_baseline_dates(spark, sf):
    return _baseline_check(
        spark,
        inputs.orders_by_date(spark, sf),
        "There is a gap",
        "baseline_date_comparison",
        [
            _number("columns_compared", "columns_compared"),
            _number("columns_with_range_change", "columns_with_range_change"),
            _number("columns_with_missing_daily_period_delta", "columns_with_delta"),
        ],
        measures=("dates",),
    )


@query
def ev_baseline_totals(spark, sf):
    return _baseline_check(
        spark,
        inputs.orders_by_date(spark, sf),
        "The total looks low",
        "baseline_total_comparison",
        [
            _number("current_row_count", "current_rows"),
            _number("baseline_row_count", "baseline_rows"),
            _number("row_count_delta", "row_delta"),
            _number("numeric_columns_compared", "columns_compared"),
            _number("columns_with_total_delta", "columns_with_delta"),
            _number("max_absolute_total_delta", "max_delta", "DOUBLE"),
        ],
        measures=("numeric",),
    )


def _schema_evidence(spark, sides) -> DataFrame:
    return _baseline_check(
        spark,
        sides,
        "The schema moved",
        "baseline_schema_comparison",
        [
            _number("current_column_count", "current_columns"),
            _number("baseline_column_count", "baseline_columns"),
            _number("shared_column_count", "shared_columns"),
            _number("inferred_kind_change_count", "kind_changes"),
        ],
        measures=("nulls", "dates"),
    )


@query
def ev_baseline_schema(spark, sf):
    return _schema_evidence(spark, inputs.parties(spark, sf))


@query
def ev_baseline_schema_wide(spark, sf):
    return _schema_evidence(spark, inputs.wide_and_narrow(spark, sf))


@query
def ev_baseline_category(spark, sf):
    return _baseline_check(
        spark,
        inputs.events_without_errors(spark, sf),
        "The mix changed",
        "baseline_category_shape_comparison",
        [
            _number("columns_compared", "columns_compared"),
            _number("columns_with_unique_count_delta", "columns_with_delta"),
            _number("max_unique_count_delta", "max_delta"),
            _number("columns_with_high_cardinality_signal_delta", "flag_changes"),
        ],
        measures=("unique", "dates"),
    )


@query
def ev_baseline_general(spark, sf):
    names = (
        "row_count_delta", "column_count_delta", "total_null_cell_delta",
        "numeric_column_count_delta", "datetime_column_count_delta",
        "text_column_count_delta", "duplicate_column_name_count_delta",
        "empty_column_name_count_delta",
    )
    return _baseline_check(
        spark,
        inputs.parties(spark, sf),
        "Something feels off",
        "baseline_general_summary",
        [_number(n, n) for n in names],
        measures=("nulls", "dates"),
    )


# --- ledger, hypotheses, findings, runs: every event is a case ----------------


def _investigation(spark, sf) -> Investigation:
    found = investigate(
        inputs.issue_cases(spark, sf), _case_tables(spark, sf), inputs.CASE_PAIRS
    )
    _release(found.close)
    return found


@query
def evidence_ledger(spark, sf):
    return _investigation(spark, sf).evidence().selectExpr(
        "case_id", "issue_type", "evidence_id", *_SIGNAL, _RELATED
    )


@query
def ledger_texts(spark, sf):
    """The ledger of an investigation that takes whole texts as statements."""
    found = investigate(
        inputs.marked_texts(spark, sf), _case_tables(spark, sf), inputs.CASE_PAIRS
    )
    _release(found.close)
    return found.evidence().selectExpr(
        "case_id", "issue_type", "evidence_id", *_SIGNAL, _RELATED
    )


@query
def ledger_execution(spark, sf):
    return checks.ledger_execution(_investigation(spark, sf).reviewed)


@query
def checks_not_run(spark, sf):
    found = checks.checks_not_run(_investigation(spark, sf).reviewed)
    return found.select("case_id", "check_id", "reason_code")


@query
def hypotheses(spark, sf):
    return _investigation(spark, sf).hypotheses().selectExpr(
        "case_id",
        "hypothesis_id",
        "status",
        "signal_level",
        *[f"{_joined(c)} AS {c}" for c in ("supporting", "contradicting", "inconclusive")],
    )


@query
def hypothesis_status_counts(spark, sf):
    return review.hypothesis_status_counts(_investigation(spark, sf).reviewed)


_FINDING = ("case_id", "item_id", "hypothesis_id")
_EVIDENCE_IDS = f"{_joined('evidence_ids')} AS evidence_ids"


@query
def findings_supported(spark, sf):
    found = review.supported_signals(_investigation(spark, sf).reviewed)
    return found.selectExpr(*_FINDING, _EVIDENCE_IDS)


@query
def findings_not_supported(spark, sf):
    found = review.not_supported_signals(_investigation(spark, sf).reviewed)
    return found.selectExpr(*_FINDING, _EVIDENCE_IDS)


@query
def findings_unclear(spark, sf):
    found = review.unclear_items(_investigation(spark, sf).reviewed)
    return found.selectExpr(
        "case_id",
        "item_id",
        "coalesce(hypothesis_id, '(open point)') AS hypothesis_id",
        _EVIDENCE_IDS,
    )


@query
def findings_checks(spark, sf):
    return review.recommended_checks(_investigation(spark, sf).reviewed)


@query
def findings_summary(spark, sf):
    return _investigation(spark, sf).findings()


@query
def report_key_metrics(spark, sf):
    return review.report_key_metrics(_investigation(spark, sf).reviewed).selectExpr(
        "case_id",
        "evidence_id",
        "ordinal",
        "metric",
        "coalesce(text, '') AS text",
        "coalesce(value, -1.0D) AS value",
    )


@query
def report_evidence_rows(spark, sf):
    return review.report_evidence_rows(_investigation(spark, sf).reviewed).drop(
        "summary"
    )


@query
def report_hypothesis_rows(spark, sf):
    return review.report_hypothesis_rows(_investigation(spark, sf).reviewed).drop(
        "rationale"
    )


@query
def report_finding_rows(spark, sf):
    return review.report_finding_rows(_investigation(spark, sf).reviewed).selectExpr(
        "case_id", "section", "item_id", "evidence_ids",
        "reason IS NOT NULL AS has_reason", "check_text IS NOT NULL AS has_check",
    )


# --- safety -------------------------------------------------------------------


@query
def scan_blocked_terms(spark, sf):
    talks = inputs.rows(spark, sf, "conversations")
    # The same talks with a verdict in every answer of the assistant.
    marked = talks.selectExpr("IF(role = 'assistant', text || ' Approved', text) AS text")
    scans = [
        safety.scan_blocked_terms(
            inputs.rows(spark, sf, "documents"), "text", "documents"
        ),
        safety.scan_blocked_terms(talks, "text", "conversations"),
        safety.scan_blocked_terms(marked, "text", "conversations_marked"),
    ]
    return reduce(DataFrame.unionByName, scans)


@query
def validate_notes(spark, sf):
    # A note per document: its text as the summary, its lines as questions. The
    # source decides what else is wrong with the note.
    note = """named_struct(
        'review_summary', text,
        'suggested_follow_up_questions', split(text, '\\n', -1),
        'suggested_human_checks', array('Look at ' || lang),
        'communication_notes',
            array(IF(source = 'src5', 'The table is APPROVED', 'For review only')),
        'limitations_to_keep_visible', array(lang))"""
    documents = inputs.rows(spark, sf, "documents").selectExpr(
        f"""CASE source
            WHEN 'src0' THEN text
            WHEN 'src1' THEN to_json(array(text))
            WHEN 'src2' THEN replace(to_json({note}),
                '"communication_notes":', '"other_notes":')
            WHEN 'src3' THEN replace(to_json({note}),
                '"limitations_to_keep_visible":["' || lang || '"]',
                '"limitations_to_keep_visible":[1]')
            WHEN 'src4' THEN replace(to_json({note}),
                '"suggested_human_checks":["Look at ' || lang || '"]',
                '"suggested_human_checks":"none"')
            ELSE to_json({note}) END AS note"""
    )
    return notes.error_counts(notes.validate_notes(documents, "note"))


@query
def safe_summary(spark, sf):
    summaries = runs.safe_summary(_investigation(spark, sf).reviewed)
    fields = {
        "run_context": {
            "current_row_count": "current_rows",
            "current_column_count": "current_columns",
            "baseline_row_count": "baseline_rows",
            "baseline_column_count": "baseline_columns",
        },
        "evidence_summary": {
            "checks_executed_count": "executed",
            "checks_not_run_count": "not_run",
        },
        "hypothesis_summary": {status: status for status in HYPOTHESIS_STATUSES},
    }
    # All fields are read back in one pass over the text.
    schema = ", ".join(
        f"{section} STRUCT<{', '.join(f'{path}: BIGINT' for path in paths)}>"
        for section, paths in fields.items()
    )
    schema = f"issue STRUCT<statement: STRING>, {schema}"
    read = summaries.withColumn("read", F.expr(f"from_json(payload, {quoted(schema)})"))
    return read.selectExpr(
        "* EXCEPT (payload, read)",
        "read.issue.statement AS statement",
        *[
            f"coalesce(read.{section}.{path}, -1L) AS {name}"
            for section, paths in fields.items()
            for path, name in paths.items()
        ],
    )


@query
def run_status(spark, sf):
    return runs.run_status(_investigation(spark, sf).reviewed)


@query
def stored_status(spark, sf):
    """Status from what is stored, over all eight states."""
    cases, stored = inputs.issue_cases(spark, sf), inputs.stored_stages(spark, sf)
    return runs.stored_status(cases, stored)


@query
def run_manifest(spark, sf):
    none = "'(none)'"
    return _investigation(spark, sf).runs().selectExpr(
        "case_id",
        "issue_type",
        "route_name",
        f"coalesce(dataset_id, {none}) AS dataset_id",
        "coalesce(row_count, -1L) AS row_count",
        "coalesce(column_count, -1L) AS column_count",
        "baseline_available",
        "coalesce(comparison_signal_count, -1L) AS comparison_signal_count",
        "coalesce(compared_column_count, -1L) AS compared_column_count",
        "checks_executed_count",
        "evidence_item_count",
        "checks_not_run_count",
        "hypothesis_count",
        "supported_hypothesis_count",
        "not_supported_hypothesis_count",
        "unclear_hypothesis_count",
        "supported_signal_count",
        "unclear_item_count",
        f"coalesce(finding_status, {none}) AS finding_status",
    )
