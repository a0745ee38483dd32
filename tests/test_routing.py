from __future__ import annotations

import random
import re

import pytest
from helpers import cases, snapshots

from framewitness.catalog.queries import QUERIES
from framewitness.functions.fixed import ISSUE_PRECEDENCE, ISSUE_TERMS, STOP_WORDS
from framewitness.operators import profile as P
from framewitness.operators import routing as R

STATEMENTS = [
    ("Order keys keep repeating", "duplicate_key", ["repeating"]),
    ("DUPLICATE KEY found", "duplicate_key", ["duplicate", "duplicate key"]),
    ("Nulls increased in the mail field", "null_increase", ["null", "nulls"]),
    ("the mail is blank more often", "null_increase", ["blank", "blank more often"]),
    ("a missing date in the feed", "date_gap", ["missing date"]),
    ("no records for one day", "date_gap", ["no records for one day"]),
    ("Status values spiked for one region", "category_shift",
     ["status", "region", "spiked"]),
    ("a status disappeared", "category_shift", ["status", "disappeared"]),
    ("the report total dropped", "total_change", ["total", "dropped", "report total"]),
    ("row count changed", "total_change", ["count changed", "row count changed"]),
    ("a column missing from the file", "schema_change", ["column missing"]),
    ("header changed", "schema_change", ["header changed"]),
    ("repeated ids and a missing column", "schema_change", ["missing column"]),
    ("it looks odd", "general_suspected_issue", []),
    ("  \t\n", "missing_issue_statement", []),
    ("", "missing_issue_statement", []),
    ("\u00a0\u2003", "missing_issue_statement", []),
    (None, "missing_issue_statement", []),
]


@pytest.fixture(scope="module")
def routed(spark):
    rows = cases(spark, *[(s, "now", None) for s, _, _ in STATEMENTS])
    return R.route(rows).orderBy("case_id").collect()


def test_types_and_terms(routed):
    for row, (_, issue_type, terms) in zip(routed, STATEMENTS):
        assert row.issue_type == issue_type
        assert row.matched_terms == terms
        assert row.issue_provided == (issue_type != "missing_issue_statement")


def test_routes(routed):
    assert routed[0].route_name == "duplicate_key_investigation"
    assert routed[13].route_name == "general_investigation"
    assert routed[14].classification_status == "missing_issue_statement"
    assert len(routed[0].planned_checks) == 3 and len(routed[13].planned_checks) == 2
    assert routed[14].planned_checks == [] and len(routed[14].review_prompts) == 1


def test_tokens_leave_out_stop_words(routed):
    assert routed[2].issue_tokens == ["mail"]
    assert routed[17].issue_tokens == []


def test_candidates(spark):
    now, _ = snapshots(spark)
    profile = P.column_profile(now)
    statements = [
        "customer ids repeated",
        "nulls in the customer email field",
        "a gap in signup_date",
        "the total dropped",
        "header changed in the customer file",
        "a status spiked",
        "it looks odd",
    ]
    rows = cases(spark, *[(s, "now", None) for s in statements])
    found: dict = {}
    ordered = R.candidate_columns(rows, profile).orderBy("case_id", "position")
    for r in ordered.collect():
        found.setdefault(r.case_id, []).append(r.column_name)
    assert found == {
        0: ["customer_id"],
        1: ["customer_id", "email"],
        2: ["signup_date"],
        3: ["worth"],
        4: ["customer_id"],
        5: ["status", "region"],
    }


def test_planned_checks_and_inputs(spark):
    rows = cases(spark, ("the total dropped", "now", "before"),
                 ("the total dropped", "now", None), (None, None, None))
    planned = R.planned_checks(R.route(rows)).collect()
    flags = {(r.case_id, r.check_id): (r.executable, r.stage) for r in planned}
    assert flags[(0, "planned_baseline_total_comparison")] == (True, "baseline_comparison")
    assert flags[(1, "planned_baseline_total_comparison")] == (False, "baseline_comparison")
    assert flags[(1, "planned_numeric_total_summary")] == (True, "current_dataset_checks")
    inputs = {r.case_id: r for r in R.plan_inputs(R.route(rows)).collect()}
    assert inputs[0].missing_inputs == []
    assert inputs[2].available_inputs == []
    assert inputs[2].missing_inputs == [
        "issue statement", "baseline dataset or prior-run artifact",
    ]


def _folded_words(statement):
    return set(re.findall("[a-z0-9]+", statement.casefold())) - set(STOP_WORDS)


def test_overlapping_terms_and_folding(spark):
    terms = [t for found in ISSUE_TERMS.values() for t in found]
    draw = random.Random(4)
    texts = ["Mißing column", "ſchema ﬁeld", "Straße", "STATUſ", "no recordſ for one day"]
    for _ in range(400):
        text = "".join(draw.choice([*terms, " ", "x", "Missing ", "column "]) for _ in range(5))
        texts.append(text[draw.randint(0, 4) :])
    texts.append("words " * 50_000 + "gap")
    rows = R.classify(cases(spark, *[(t, None, None) for t in texts])).collect()
    for row in rows:
        text = row.issue_statement.casefold()
        hits = {k: [t for t in found if t in text] for k, found in ISSUE_TERMS.items()}
        want = next((k for k in ISSUE_PRECEDENCE if hits.get(k)), "general_suspected_issue")
        if not text.strip():
            want = "missing_issue_statement"
        assert (row.issue_type, row.matched_terms) == (want, hits.get(want, []))
        assert set(row.issue_tokens) == _folded_words(row.issue_statement)


def _mentions(name, words):
    name = name.casefold()
    own = set(re.findall("[a-z0-9]+", name))
    return bool(name) and (bool(own & words) or name.replace("_", " ") in " ".join(sorted(words)))


def test_mentions_equal_the_rule(spark):
    draw = random.Random(9)
    parts = ["id", "a", "order", "rder", "der", "ids", "key", "keys", "x1", "", "größe", "straße", "ID"]
    names = ["_", "__", " ", "a-b", "order key", "", "é", "r_k", "s_", "_k", "status_of_order"]
    names += ["_".join(draw.choices(parts, k=draw.randint(1, 3))) for _ in range(150)]
    names += ["".join(draw.choices("aidorkey_", k=draw.randint(1, 7))) for _ in range(150)]
    statements = [
        "header changed " + " ".join(draw.choices([*parts, "borders", "keyed", "strasse"], k=draw.randint(0, 6)))
        for _ in range(80)
    ]
    columns = [("t", i, name, "text") for i, name in enumerate(names)]
    profile = spark.createDataFrame(
        columns, "dataset_id string, position int, column_name string, inferred_kind string"
    )
    rows = cases(spark, *[(s, "t", None) for s in statements], (statements[0], None, None))
    found = {(r.case_id, r.position) for r in R.candidate_columns(rows, profile).collect()}
    want = {
        (i, p)
        for i, s in enumerate(statements)
        for p, name in enumerate(names)
        if _mentions(name, _folded_words(s))
    }
    assert found == want and len(want) > 1_000


def test_many_columns_and_cases(spark):
    """Cases times columns would be 5 billion comparisons."""
    columns = spark.range(50_000).selectExpr(
        "'wide' AS dataset_id", "int(id) AS position", "concat('measure', id, '_q') AS column_name",
        "'text' AS inferred_kind",
    )
    rows = spark.range(100_000).selectExpr(
        "id AS case_id",
        "concat('header changed near measure', id % 60000, ' of plant', id) AS issue_statement",
        "'wide' AS dataset_id", "CAST(NULL AS STRING) AS baseline_id",
    )
    found = R.candidate_columns(rows, columns)
    assert found.filter("column_name <> concat('measure', case_id % 60000, '_q')").count() == 0
    assert found.count() == 90_000


def test_a_text_is_read_once(spark):
    for name in ("route_documents", "route_conversations"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and plan.count("(?=") == 2, plan


def test_candidates_classify_once(spark):
    """Finding 2: four readings of the statements, with the words of all of them."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = cases(spark, *[(f"header changed near measure{i}", "t", None) for i in range(50)])
    rows = rows.mapInArrow(counted, rows.schema)
    columns = spark.createDataFrame(
        [("t", i, f"measure{i}_", "text") for i in range(50)],
        "dataset_id string, position int, column_name string, inferred_kind string",
    )
    kept = []

    def keep(df):
        kept.append(df.persist())
        return kept[-1]

    found = R.candidate_columns(rows, columns, keep=keep)
    pairs = {(r.case_id, r.position) for r in found.collect()}
    kept[0].unpersist()
    assert pairs == {(i, i) for i in range(50)}
    assert read.value == 50
