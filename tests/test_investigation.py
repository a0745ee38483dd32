from __future__ import annotations

import json

import pytest
from helpers import cases, snapshots, table

from framewitness import investigate
from framewitness.functions.fixed import BLOCKED_TERMS
from framewitness.operators import checks, compare, review, runs, safety
from framewitness.operators import profile as P

STATEMENTS = [
    "Customer ids keep repeating",
    "Nulls in the customer email field",
    "A gap in signup_date",
    "The total dropped",
    "Header changed in the customer file",
    "A status spiked",
    "It looks odd",
    None,
]


@pytest.fixture(scope="module")
def found(spark):
    now, before = snapshots(spark)
    rows = [(s, "now", "before") for s in STATEMENTS]
    rows += [(s, "now", None) for s in STATEMENTS]
    rows += [("The total dropped", None, None), (None, None, None)]
    return investigate(cases(spark, *rows), [now, before], [("now", "before")])


@pytest.fixture(scope="module")
def reviewed(found):
    return {r.case_id: r for r in found.reviewed.collect()}


def _signals(row):
    return [(e.check_id, e.signal, e.signal_strength) for e in row.evidence]


def _metrics(row, check_id):
    item = next(e for e in row.evidence if e.check_id == check_id)
    return {m.name: m.value if m.value is not None else m.text for m in item.metrics}


def _statuses(row):
    return [h.status.split("_")[0] for h in row.hypotheses]


def test_evidence_of_every_route(reviewed):
    assert _signals(reviewed[0]) == [
        ("duplicate_key_summary", "present", "medium"),
        ("key_null_summary", "absent", "low"),
        ("baseline_duplicate_comparison", "present", "medium"),
    ]
    assert _metrics(reviewed[0], "duplicate_key_summary") == {
        "candidate_column_count": 1.0,
        "columns_with_duplicate_non_null_values": 1.0,
        "max_duplicate_value_count": 1.0,
        "max_duplicate_value_percentage": 8.33,
    }
    nulls = _metrics(reviewed[1], "current_null_summary")
    assert (nulls["total_null_cells"], nulls["total_cells_assessed"]) == (2.0, 24.0)
    assert nulls["max_null_percentage"] == 16.67
    assert _signals(reviewed[2]) == [
        ("date_range_summary", "present", "low"),
        ("date_gap_summary", "absent", "low"),
        ("baseline_date_comparison", "absent", "low"),
    ]
    assert _metrics(reviewed[3], "numeric_total_summary")["max_column_total"] == 1721.80
    total = _metrics(reviewed[3], "baseline_total_comparison")
    assert total["max_absolute_total_delta"] == 41.80
    assert _metrics(reviewed[4], "current_schema_summary")["column_count"] == 6.0
    kinds = json.loads(_metrics(reviewed[4], "current_schema_summary")["inferred_kind_counts"])
    assert kinds == {"datetime": 1, "decimal": 1, "text": 4}
    shape = _metrics(reviewed[5], "categorical_shape_summary")
    assert (shape["max_unique_count"], shape["max_unique_percentage"]) == (4.0, 33.33)
    general = _metrics(reviewed[6], "general_profile_signal_summary")
    assert (general["row_count"], general["total_null_cells"]) == (12.0, 2.0)
    assert reviewed[7].evidence == []


def test_evidence_ids_run_per_case(reviewed):
    assert [e.evidence_id for e in reviewed[0].evidence] == ["ev-001", "ev-002", "ev-003"]
    assert [e.evidence_id for e in reviewed[8].evidence] == ["ev-001", "ev-002"]


def test_hypotheses_with_baseline(reviewed):
    expected = [
        ["supported", "supported", "not"],
        ["supported", "supported", "unclear"],
        ["not", "not", "unclear"],
        ["supported", "supported", "unclear"],
        ["supported", "not", "unclear"],
        ["supported", "not", "unclear"],
        ["supported", "supported", "unclear"],
        [],
    ]
    assert [_statuses(reviewed[i]) for i in range(8)] == expected
    first = reviewed[0].hypotheses
    assert [h.hypothesis_id for h in first] == ["hyp-001", "hyp-002", "hyp-003"]
    assert first[0].supporting == ["ev-001"] and first[0].signal_level == "medium"
    assert first[2].contradicting == ["ev-002"] and first[2].signal_level == "low"
    totals = reviewed[3].hypotheses[0]
    assert totals.supporting == ["ev-001", "ev-002"] and totals.signal_level == "low"
    assert len(reviewed[2].hypotheses[0].limitations) == 4


def test_hypotheses_without_baseline_are_unclear(reviewed):
    for i in range(8, 15):
        assert reviewed[i].hypotheses[1].status == "unclear"
        assert reviewed[i].hypotheses[1].signal_level == "not_applicable"


def test_findings(reviewed):
    first = reviewed[0]
    assert [s.item_id for s in first.supported_signals] == ["sig-001", "sig-002"]
    assert [s.evidence_ids for s in first.not_supported_signals] == [["ev-002"]]
    assert [u.item_id for u in first.unclear_items] == ["unc-001", "unc-002", "unc-003"]
    assert len(first.recommended_checks) == 4
    assert len(reviewed[6].recommended_checks) == 5
    assert len(reviewed[1].unclear_items) == 4
    assert reviewed[7].unclear_items == [] and reviewed[7].recommended_checks == []


def test_checks_not_run(reviewed):
    def left(i):
        return {c.check_id: c.reason_code for c in reviewed[i].checks_not_run}

    assert left(3) == {"planned_row_count_change_review": "baseline_unavailable"}
    assert left(11) == {
        "planned_baseline_total_comparison": "baseline_unavailable",
        "planned_row_count_change_review": "baseline_unavailable",
    }
    assert left(0) == {"planned_duplicate_pattern_review": "needs_interpretation"}
    assert left(7) == {} and left(16) == {}


def test_execution_status_and_manifest(found):
    execution = {r.case_id: r for r in checks.ledger_execution(found.reviewed).collect()}
    assert len(execution) == 16
    assert execution[0].checks_executed_count == 3
    assert execution[7].status == "not_executed"
    status = {r.case_id: (r.status, r.stage) for r in
              runs.run_status(found.reviewed).collect()}
    assert status[0] == ("report_written", "markdown_report_created")
    assert status[7] == ("plan_not_ready", "missing_issue_statement")
    assert status[16] == ("planned", "investigation_plan_created")
    quiet = {r.case_id: r.status for r in
             runs.run_status(found.reviewed, reported=False).collect()}
    assert quiet[0] == "findings_summarized"
    notes = found.reviewed.sparkSession.createDataFrame(
        [(0, True), (1, False), (7, True)], "case_id int, notes_valid boolean"
    )
    noted = {r.case_id: (r.status, r.stage) for r in
             runs.run_status(found.reviewed, notes=notes).collect()}
    assert noted[0] == ("llm_notes_written", "optional_llm_notes_created")
    assert noted[1] == ("report_written", "llm_notes_failed_validation")
    assert noted[7][0] == "plan_not_ready"
    manifest = {r.case_id: r for r in found.runs().collect()}
    assert manifest[0].comparison_signal_count == 1
    assert manifest[0].compared_column_count == 6
    assert manifest[8].comparison_signal_count is None
    assert len(manifest) == 18


def test_shared_outcomes_equal_direct_evaluation(spark, found, reviewed):
    now, before = snapshots(spark)
    profile = P.profiles([now, before])
    pair = spark.createDataFrame(
        [("now", "before")], "current_id string, baseline_id string"
    )
    rows = cases(spark, *[(s, "now", "before") for s in STATEMENTS])
    compared = compare.compare(profile, pair)
    facts = checks.table_facts(profile)
    # No bound given: the salted join must give what the broadcast gives.
    evidence = checks.case_evidence(rows, facts, compared)
    direct = {r.case_id: r for r in review.review(evidence).collect()}
    assert len(direct) == len(STATEMENTS)
    for i, row in direct.items():
        assert row.evidence == reviewed[i].evidence
        assert row.hypotheses == reviewed[i].hypotheses
        assert row.counts == reviewed[i].counts


def test_report_rows(found):
    metrics = review.report_key_metrics(found.reviewed).filter("case_id = 1").collect()
    per_item: dict = {}
    for m in metrics:
        per_item.setdefault(m.evidence_id, []).append(m.metric)
    assert len(per_item["ev-001"]) == 6 and "column_deltas" not in per_item["ev-002"]
    few = review.report_key_metrics(found.reviewed, top=4).filter("case_id = 1")
    assert few.filter("evidence_id = 'ev-001'").count() == 4
    rows = {(r.case_id, r.evidence_id): r.related_columns for r in
            review.report_evidence_rows(found.reviewed).collect()}
    assert rows[(0, "ev-001")] == "customer_id" and rows[(0, "ev-002")] == "None"
    hyps = review.report_hypothesis_rows(found.reviewed).filter("case_id = 3").collect()
    assert hyps[0].supporting == "ev-001, ev-002"
    sections = review.report_finding_rows(found.reviewed).filter("case_id = 0").collect()
    assert len(sections) == 2 + 1 + 3


def test_safe_summary_and_outputs_hold_no_values(spark, found):
    summaries = runs.safe_summary(found.reviewed).collect()
    assert len(summaries) == 14 and all(s.is_safe for s in summaries)
    text = " ".join(s.payload for s in summaries)
    assert "K-01" not in text and "ann@a.example" not in text
    now, before = snapshots(spark)
    bad = cases(spark, ("Duplicate CUST-001 found", "now", None))
    hit = investigate(bad, [now, before], [("now", "before")])
    row = runs.safe_summary(hit.reviewed).collect()[0]
    assert not row.is_safe and row.payload is None
    for df in (found.profile, found.comparison, found.reviewed, found.runs()):
        assert safety.forbidden_fields(df.schema) == []
    everything = str(found.reviewed.drop("issue_statement").collect())
    everything += str(found.profile.collect()) + str(found.comparison.collect())
    assert not [t for t in BLOCKED_TERMS if t.lower() in everything.lower()]
    assert "ann@a.example" not in everything and "K-01" not in everything


def test_fallback_columns(spark):
    t = table(
        spark,
        [(1, "a", "2026-01-01"), (2, "a", "2026-01-03")],
        "amount int, label string, note string",
        "t",
    )
    rows = cases(spark, ("Keys repeated", "t", None), ("Blank cells", "t", None),
                 ("There is a gap", "t", None), ("A mix changed", "t", None))
    got = {r.case_id: r for r in investigate(rows, [t]).reviewed.collect()}
    assert _metrics(got[0], "duplicate_key_summary")["candidate_column_count"] == 0.0
    assert _metrics(got[1], "current_null_summary")["assessed_column_count"] == 3.0
    gap = _metrics(got[2], "date_gap_summary")
    assert (gap["missing_daily_period_count"], gap["min_date"]) == (1.0, "2026-01-01")
    shape = got[3].evidence[0]
    assert shape.related_columns == ["label"]


def test_unparsed_dates_are_unclear(spark):
    t = table(spark, [("soon",)], "birthday string", "t")
    got = investigate(cases(spark, ("There is a gap", "t", None)), [t]).reviewed.collect()[0]
    assert [(e.signal) for e in got.evidence] == ["unclear", "absent"]
    none = table(spark, [("x",)], "word string", "t")
    total = investigate(cases(spark, ("The total fell", "t", None)), [none])
    row = total.reviewed.collect()[0]
    assert [e.signal for e in row.evidence] == ["unclear", "present"]


def test_bad_arguments(spark):
    now, before = snapshots(spark)
    rows = cases(spark, ("x", "now", None))
    with pytest.raises(ValueError):
        investigate(rows, [now, now])
    with pytest.raises(ValueError):
        investigate(rows, [now], [("now", "before")])


def _jobs(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))


def test_building_starts_no_job_and_leaves_nothing(spark):
    now, before = snapshots(spark)
    rows = cases(spark, *[(s, "now", "before") for s in STATEMENTS])
    spark.sparkContext.setJobGroup("building", "")
    try:
        found = investigate(rows, [now, before], [("now", "before")])
        outputs = found.evidence(), found.hypotheses(), found.findings(), found.runs()
        assert _jobs(spark) == 0
        first = [sorted(map(str, df.collect())) for df in outputs]
        assert _jobs(spark) > 0
    finally:
        spark.sparkContext.setJobGroup("", "")
    found.close()
    assert not any(frame.is_cached for frame in found.kept)
    again = found.evidence(), found.hypotheses(), found.findings(), found.runs()
    assert [sorted(map(str, df.collect())) for df in again] == first


def test_one_table_with_all_cases(spark):
    t = table(spark, [(1, "a"), (2, "a")], "order_id int, label string", "t")
    many = spark.range(5_000).selectExpr(
        "id AS case_id", "'Order keys keep repeating, case ' || id AS issue_statement",
        "IF(id % 10 = 0, NULL, 't') AS dataset_id", "CAST(NULL AS STRING) AS baseline_id",
    )
    with investigate(many, [t]) as found:
        assert found.reviewed.count() == 5_000
        assert found.evidence().filter("check_id = 'key_null_summary'").count() == 4_500


def test_statements_are_not_shuffled(spark):
    """Finding 1: whole texts went through two joins and a second kept frame."""
    now, before = snapshots(spark)
    rows = cases(spark, *[(s, "now", "before") for s in STATEMENTS])
    with investigate(rows, [now, before], [("now", "before")]) as found:
        plan = found.evidence()._jdf.queryExecution().sparkPlan().toString()
        scans = [line for line in plan.splitlines() if "InMemoryTableScan" in line]
        assert scans and not [line for line in scans if "issue_statement" in line], plan


def test_summaries_share_what_is_not_the_statement(spark):
    """Finding 3: the JSON text of an outcome was made and searched for each of its cases."""
    now, before = snapshots(spark)
    rows = cases(spark, *[(s, "now", "before") for s in STATEMENTS],
                 ('Keys "repeating", \\ and\n\tgap', "now", None),
                 ("The total was APPROVED", "now", None))
    with investigate(rows, [now, before], [("now", "before")]) as found:
        assert "summary_rest" in found.reviewed.columns
        got = {r.case_id: r for r in runs.safe_summary(found.reviewed).collect()}
        apart = found.reviewed.drop("summary_rest", "summary_safe")
        assert got == {r.case_id: r for r in runs.safe_summary(apart).collect()}
        assert list(json.loads(got[0].payload)["issue"]) == ["statement", "issue_type", "selected_route"]
        assert json.loads(got[8].payload)["issue"]["statement"] == 'Keys "repeating", \\ and\n\tgap'
        assert (got[9].payload, got[9].is_safe) == (None, False)
