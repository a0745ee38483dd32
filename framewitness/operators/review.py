"""Hypotheses and findings: projections over the evidence of each case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.functions.expr import array_of, pick, quoted, struct_of, unnest
from framewitness.functions.fixed import (
    HYPOTHESIS_STATUSES,
    NOT_ASSESSED,
    NOT_SUPPORTED,
    SUPPORTED,
    UNCLEAR,
    UNREPORTED_METRIC_PARTS,
)
from framewitness.functions.wording import (
    BASELINE_ABSENT_RATIONALE,
    COMMON_LIMITATIONS,
    DAILY_LIMITATION,
    NO_EVIDENCE_RATIONALE,
    OPEN_POINTS,
    UNCLEAR_RATIONALE,
)

_NO_TEXT = array_of(())


def _hypotheses() -> str:
    """One struct per rule of the case's issue type.

    x.r is the rule, x.found the matching evidence, x.i the running number.
    """
    evidence = "get(x.found, 0)"
    none = "size(x.found) = 0"
    present = f"{evidence}.signal = 'present'"
    absent = f"{evidence}.signal = 'absent'"
    refuted = f"{absent} AND x.r.otherwise = '{NOT_SUPPORTED}'"
    ids = pick("x.found", "evidence_id")
    one = f"array({evidence}.evidence_id)"
    status = f"""CASE
        WHEN x.r.kind = 'context' THEN '{UNCLEAR}'
        WHEN x.r.kind = 'baseline' AND {none} AND NOT has_baseline THEN '{UNCLEAR}'
        WHEN {none} THEN '{NOT_ASSESSED}'
        WHEN x.r.kind = 'recorded' OR {present} THEN '{SUPPORTED}'
        WHEN {absent} THEN x.r.otherwise
        ELSE '{UNCLEAR}' END"""
    level = f"""CASE
        WHEN x.r.kind = 'context' OR {none} THEN 'not_applicable'
        WHEN x.r.kind = 'recorded' THEN 'low'
        WHEN {present} THEN {evidence}.signal_strength
        WHEN {refuted} THEN 'low'
        ELSE 'not_applicable' END"""
    rationale = f"""CASE
        WHEN x.r.kind = 'context' THEN x.r.rationale
        WHEN x.r.kind = 'baseline' AND {none} THEN {quoted(BASELINE_ABSENT_RATIONALE)}
        WHEN {none} THEN {quoted(NO_EVIDENCE_RATIONALE)}
        WHEN x.r.kind = 'recorded' OR {present} OR {absent}
            THEN {evidence}.check_id || ': ' || {evidence}.summary
        ELSE {quoted(UNCLEAR_RATIONALE)} END"""
    common = array_of(COMMON_LIMITATIONS)
    daily = array_of((*COMMON_LIMITATIONS, DAILY_LIMITATION))
    row = struct_of(
        hypothesis_id="format_string('hyp-%03d', x.i + 1)",
        statement="x.r.statement",
        status=status,
        signal_level=level,
        supporting=f"""CASE WHEN {none} THEN {_NO_TEXT}
            WHEN x.r.kind = 'recorded' THEN {ids}
            WHEN {present} THEN {one} ELSE {_NO_TEXT} END""",
        contradicting=f"""CASE WHEN {none} OR x.r.kind = 'recorded' THEN {_NO_TEXT}
            WHEN {refuted} THEN {one} ELSE {_NO_TEXT} END""",
        inconclusive=f"""CASE WHEN {none} OR x.r.kind = 'recorded' THEN {_NO_TEXT}
            WHEN {present} OR ({refuted}) THEN {_NO_TEXT} ELSE {one} END""",
        rationale=rationale,
        limitations=f"IF(x.r.daily, {daily}, {common})",
        checks="x.r.checks",
    )
    matched = """transform(hypothesis_rules, (r, i) -> named_struct('i', i, 'r', r,
        'found', filter(evidence, e -> array_contains(r.check_ids, e.check_id))))"""
    return f"transform({matched}, x -> {row})"


def review(case_evidence: DataFrame) -> DataFrame:
    """Adds the hypotheses and the findings of every case.

    Cases without a statement or without a table get neither.
    """
    active = "issue_provided AND has_data"
    hypotheses = _hypotheses()
    supported = _signals("sig", SUPPORTED, "supporting")
    not_supported = _signals("notsup", NOT_SUPPORTED, "contradicting")
    checks = f"array_distinct(concat(route_checks, flatten({pick('hypotheses', 'checks')})))"
    return (
        case_evidence.withColumn(
            "hypotheses", F.expr(f"filter({hypotheses}, h -> {active})")
        )
        .withColumn("supported_signals", F.expr(supported))
        .withColumn("not_supported_signals", F.expr(not_supported))
        .withColumn("unclear_items", F.expr(f"filter({_unclear()}, u -> {active})"))
        .withColumn(
            "recommended_checks", F.expr(f"IF({active}, {checks}, {_NO_TEXT})")
        )
        .withColumn("counts", F.expr(_counts()))
        .drop("hypothesis_rules", "route_checks")
    )


def _counts() -> str:
    """Every count later tables show, taken where the arrays are at hand."""
    statuses = {
        status: f"bigint(size(filter(hypotheses, h -> h.status = '{status}')))"
        for status in HYPOTHESIS_STATUSES
    }
    ran = f"size(array_distinct({pick('evidence', 'check_id')}))"
    sizes = {
        "checks_executed": ran,
        "evidence": "size(evidence)",
        "not_run": "size(checks_not_run)",
        "hypotheses": "size(hypotheses)",
        "supported_signals": "size(supported_signals)",
        "not_supported_signals": "size(not_supported_signals)",
        "unclear_items": "size(unclear_items)",
        "recommended_checks": "size(recommended_checks)",
    }
    counted = {name: f"bigint({text})" for name, text in sizes.items()}
    return struct_of(**statuses, **counted)


def _signals(prefix: str, status: str, evidence: str) -> str:
    row = struct_of(
        item_id=f"format_string('{prefix}-%03d', i + 1)",
        hypothesis_id="h.hypothesis_id",
        statement="h.statement",
        evidence_ids=f"h.{evidence}",
    )
    return (
        f"transform(filter(hypotheses, h -> h.status = '{status}'), (h, i) -> {row})"
    )


def _unclear() -> str:
    """Open hypotheses, then the points every case keeps open."""
    open_ = (
        f"filter(hypotheses, h -> h.status IN ('{UNCLEAR}', '{NOT_ASSESSED}'))"
    )
    row = struct_of(
        item_id="format_string('unc-%03d', i + 1)",
        hypothesis_id="h.hypothesis_id",
        statement="h.statement",
        reason="h.rationale",
        evidence_ids="h.inconclusive",
        check="get(h.checks, 0)",
    )
    points = []
    for n, (statement, reason, check) in enumerate(OPEN_POINTS, start=1):
        points.append(
            struct_of(
                item_id=f"format_string('unc-%03d', size({open_}) + {n})",
                hypothesis_id="CAST(NULL AS STRING)",
                statement=quoted(statement),
                reason=quoted(reason),
                evidence_ids=_NO_TEXT,
                check=quoted(check),
            )
        )
    return f"concat(transform({open_}, (h, i) -> {row}), array({', '.join(points)}))"


# --- tables -------------------------------------------------------------------


def hypotheses(reviewed: DataFrame) -> DataFrame:
    return unnest(reviewed, "hypotheses", "hypothesis_id", "case_id", "issue_type")


def hypothesis_status_counts(reviewed: DataFrame) -> DataFrame:
    """Count per status, zero-filled, one row per case."""
    return reviewed.selectExpr(
        "case_id", *[f"counts.{status}" for status in HYPOTHESIS_STATUSES]
    )


def supported_signals(reviewed: DataFrame) -> DataFrame:
    return unnest(reviewed, "supported_signals", "item_id", "case_id")


def not_supported_signals(reviewed: DataFrame) -> DataFrame:
    return unnest(reviewed, "not_supported_signals", "item_id", "case_id")


def unclear_items(reviewed: DataFrame) -> DataFrame:
    return unnest(reviewed, "unclear_items", "item_id", "case_id")


def recommended_checks(reviewed: DataFrame) -> DataFrame:
    row = "struct(bigint(i + 1) AS check_ordinal, t AS check_text)"
    texts = f"transform(recommended_checks, (t, i) -> {row})"
    return unnest(reviewed, texts, "check_ordinal", "case_id")


def findings_summary(reviewed: DataFrame) -> DataFrame:
    """Counts per case, for cases that were reviewed."""
    # Only reviewed cases have hypotheses. A filter on issue_provided would be
    # pushed below the join and classify every statement a second time.
    return reviewed.filter("counts.hypotheses > 0").selectExpr(
        "case_id",
        "counts.supported_signals AS supported_signal_count",
        "counts.not_supported_signals AS not_supported_signal_count",
        f"counts.{UNCLEAR} AS unclear_signal_count",
        f"counts.{NOT_ASSESSED} AS not_assessed_count",
        "'review_required' AS finding_status",
    )


def report_key_metrics(reviewed: DataFrame, *, top: int | None = None) -> DataFrame:
    """Scalar metrics of each evidence item, for a report; the first ``top`` if given."""
    hidden = " OR ".join(
        f"contains(lower(m.name), {quoted(p)})" for p in UNREPORTED_METRIC_PARTS
    )
    filled = "(m.value IS NOT NULL OR m.text IS NOT NULL)"
    shown = f"filter(metrics, m -> m.scalar AND {filled} AND NOT ({hidden}))"
    return (
        unnest(reviewed, "evidence", "evidence_id", "case_id")
        .selectExpr(
            "case_id",
            "evidence_id",
            f"posexplode({shown if top is None else f'slice({shown}, 1, {top})'})"
            " AS (pos, m)",
        )
        .selectExpr(
            "case_id",
            "evidence_id",
            "bigint(pos + 1) AS ordinal",
            "m.name AS metric",
            "m.value AS value",
            "m.text AS text",
        )
    )


def _joined(array: str) -> str:
    return f"IF(size({array}) = 0, 'None', array_join({array}, ', '))"


def report_evidence_rows(reviewed: DataFrame) -> DataFrame:
    """The evidence table of a report: flat rows, lists as text."""
    return unnest(reviewed, "evidence", "evidence_id", "case_id").selectExpr(
        "case_id",
        "evidence_id",
        "check_name",
        "signal",
        "signal_strength",
        f"{_joined('related_columns')} AS related_columns",
        "summary",
    )


def report_hypothesis_rows(reviewed: DataFrame) -> DataFrame:
    return unnest(reviewed, "hypotheses", "hypothesis_id", "case_id").selectExpr(
        "case_id",
        "hypothesis_id",
        "status",
        "signal_level",
        "statement",
        *[f"{_joined(c)} AS {c}" for c in ("supporting", "contradicting", "inconclusive")],
        "rationale",
    )


def report_finding_rows(reviewed: DataFrame) -> DataFrame:
    """Signals and unclear items of a report in one table, by section."""

    def section(source: str, reason: str, check: str) -> DataFrame:
        return unnest(reviewed, source, "item_id", "case_id").selectExpr(
            "case_id",
            f"'{source}' AS section",
            "item_id",
            "statement",
            f"{_joined('evidence_ids')} AS evidence_ids",
            f"{reason} AS reason",
            f"{check} AS check_text",
        )

    none = "CAST(NULL AS STRING)"
    return (
        section("supported_signals", none, none)
        .unionByName(section("not_supported_signals", none, none))
        .unionByName(section("unclear_items", "reason", "check"))
    )
