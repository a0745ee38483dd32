"""Where each case stands, and what it produced, without payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.functions.expr import quoted, struct_of
from framewitness.functions.fixed import (
    HYPOTHESIS_STATUSES,
    NOT_SUPPORTED,
    SUPPORTED,
    UNCLEAR,
)
from framewitness.operators.checks import with_shared
from framewitness.operators.routing import route
from framewitness.operators.safety import holds_blocked_term

# --- Fixed values: (status, stage) of a run -----------------------------------
RUN_STAGES = {
    "notes": ("llm_notes_written", "optional_llm_notes_created"),
    "notes_failed": ("report_written", "llm_notes_failed_validation"),
    "report": ("report_written", "markdown_report_created"),
    "findings": ("findings_summarized", "hypotheses_and_findings_created"),
    "evidence": ("evidence_recorded", "deterministic_checks_recorded"),
    "missing": ("plan_not_ready", "missing_issue_statement"),
    "profiled": ("profiled_planned", "dataset_profiled_plan_created"),
    "planned": ("planned", "investigation_plan_created"),
}


# What a run has reached, the furthest first, by what exists of it.
_CONDITIONS = {
    "notes": "issue_provided AND notes_valid",
    "notes_failed": "issue_provided AND NOT notes_valid",
    "report": "issue_provided AND has_report",
    "findings": "issue_provided AND has_findings",
    "evidence": "issue_provided AND has_evidence",
    "missing": "NOT issue_provided",
    "profiled": "has_data",
}


def _with_status(state: DataFrame) -> DataFrame:
    def chain(which: int) -> str:
        whens = " ".join(
            f"WHEN {condition} THEN {quoted(RUN_STAGES[name][which])}"
            for name, condition in _CONDITIONS.items()
        )
        return f"CASE {whens} ELSE {quoted(RUN_STAGES['planned'][which])} END"

    return state.selectExpr(
        "case_id",
        "issue_type",
        "route_name",
        f"{chain(0)} AS status",
        f"{chain(1)} AS stage",
    )


def run_status(
    reviewed: DataFrame, *, reported: bool = True, notes: DataFrame | None = None
) -> DataFrame:
    """Status and stage of each case: the furthest thing that exists.

    ``notes`` (case_id, notes_valid) marks cases with validated notes;
    ``reported`` says whether report rows were written for reviewed cases.
    ``stored_status`` reads both off what is stored.
    """
    state = reviewed.selectExpr(
        "case_id",
        "issue_type",
        "route_name",
        "issue_provided",
        "has_data",
        f"counts.hypotheses > 0 AND {'true' if reported else 'false'} AS has_report",
        "counts.hypotheses > 0 AS has_findings",
        "issue_provided AND has_data AS has_evidence",
    )
    if notes is None:
        state = state.withColumn("notes_valid", F.lit(None).cast("boolean"))
    else:
        state = state.join(notes.select("case_id", "notes_valid"), "case_id", "left")
    return _with_status(state)


def stored_status(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status and stage of each case, from the stages that a manifest says are there.

    ``cases`` are as for routing, ``manifest`` has stage, case_id (as text) and status, a
    row for each stage and case (``StageStore.manifest``). Notes that are stored with
    another status than 'completed' failed validation. Cases without a row in the
    manifest, and stages with other names, count as nothing stored.
    """
    exists = {
        "has_report": "bool_or(stage = 'report')",
        "has_findings": "bool_or(stage = 'hypotheses') AND bool_or(stage = 'findings')",
        "has_evidence": "bool_or(stage = 'evidence')",
        "notes_valid": "bool_or(IF(stage = 'notes', status = 'completed', NULL))",
    }
    stored = (
        manifest.groupBy(F.col("case_id").alias("stored_case"))
        .agg(*[F.expr(text).alias(name) for name, text in exists.items()])
    )
    routed = route(cases).select(
        "case_id", "issue_type", "route_name", "issue_provided",
        F.expr("dataset_id IS NOT NULL").alias("has_data"),
    )
    joined = routed.join(stored, F.expr("CAST(case_id AS STRING) = stored_case"), "left")
    return _with_status(joined)


def run_manifest(reviewed: DataFrame, comparison: DataFrame) -> DataFrame:
    """Counts of everything a case produced."""
    signals = comparison.selectExpr(
        "current_id AS dataset_id",
        "baseline_id",
        "signal_count AS comparison_signal_count",
        "compared_column_count",
    )
    # As for evidence, one row per pair meets very many cases.
    joined = with_shared(reviewed, signals, ["dataset_id", "baseline_id"])
    return joined.selectExpr(
        "case_id",
        "issue_type",
        "route_name",
        "dataset_id",
        "row_count",
        "column_count",
        "has_baseline AS baseline_available",
        "comparison_signal_count",
        "compared_column_count",
        "counts.checks_executed AS checks_executed_count",
        "counts.evidence AS evidence_item_count",
        "counts.not_run AS checks_not_run_count",
        "counts.hypotheses AS hypothesis_count",
        f"counts.{SUPPORTED} AS supported_hypothesis_count",
        f"counts.{NOT_SUPPORTED} AS not_supported_hypothesis_count",
        f"counts.{UNCLEAR} AS unclear_hypothesis_count",
        "counts.supported_signals AS supported_signal_count",
        "counts.unclear_items AS unclear_item_count",
        "CASE WHEN issue_provided AND has_data THEN 'review_required' END"
        " AS finding_status",
    )


#: What a summary begins with; the statement follows, and then what cases share.
_SUMMARY_HEAD = '{"issue":{'


def with_summary(reviewed: DataFrame) -> DataFrame:
    """Adds all of a summary that does not come from the statement: summary_rest, its
    text, and summary_safe. Cases of one outcome share both."""
    items = (
        "transform(evidence, e -> struct(e.evidence_id, e.check_id, e.signal,"
        " e.signal_strength, e.related_columns, e.summary))"
    )
    rules = (
        "transform(hypotheses, h -> struct(h.hypothesis_id, h.status, h.signal_level,"
        " h.statement, h.supporting, h.contradicting, h.inconclusive))"
    )
    payload = struct_of(
        issue=struct_of(issue_type="issue_type", selected_route="route_name"),
        run_context=struct_of(
            current_row_count="row_count",
            current_column_count="column_count",
            baseline_available="has_baseline",
            baseline_row_count="baseline_row_count",
            baseline_column_count="baseline_column_count",
        ),
        evidence_summary=struct_of(
            evidence_item_count="counts.evidence",
            checks_executed_count="counts.checks_executed",
            checks_not_run_count="counts.not_run",
            evidence_items=items,
        ),
        hypothesis_summary=struct_of(
            **{status: f"counts.{status}" for status in HYPOTHESIS_STATUSES},
            hypotheses=rules,
        ),
        findings=struct_of(
            finding_status="'review_required'",
            supported_signal_count="counts.supported_signals",
            not_supported_signal_count="counts.not_supported_signals",
            unclear_item_count="counts.unclear_items",
            recommended_checks="recommended_checks",
        ),
    )
    return (
        reviewed.withColumn(
            "summary_rest", F.expr(f"substr(to_json({payload}), {len(_SUMMARY_HEAD) + 1})")
        )
        .withColumn("folded", F.expr("lower(summary_rest)"))
        .withColumn("summary_safe", F.expr(f"NOT {holds_blocked_term('folded')}"))
        .drop("folded")
    )


def safe_summary(reviewed: DataFrame) -> DataFrame:
    """Aggregate-only JSON summary of each reviewed case.

    A summary with a blocked term does not leave: its text is null. No blocked term holds
    a quote, so none reaches from the statement into the rest, and each is looked for on
    its own: in the statement case by case, in the rest once for all that share it.
    """
    if "summary_rest" not in reviewed.columns:
        reviewed = with_summary(reviewed)
    said = "to_json(named_struct('statement', issue_statement))"
    return (
        reviewed.filter("counts.hypotheses > 0")
        .withColumn("said", F.expr(said))
        .withColumn("folded", F.expr("lower(said)"))
        .withColumn("is_safe", F.expr(f"summary_safe AND NOT {holds_blocked_term('folded')}"))
        .selectExpr(
            "case_id",
            "issue_type",
            "counts.evidence AS evidence_count",
            "counts.hypotheses AS hypothesis_count",
            "counts.unclear_items AS unclear_count",
            "counts.recommended_checks AS check_count",
            f"""IF(is_safe, concat({quoted(_SUMMARY_HEAD)},
                IF(issue_statement IS NULL, '', substr(said, 2, length(said) - 2) || ','),
                summary_rest), NULL) AS payload""",
            "is_safe",
        )
    )
