from __future__ import annotations

from helpers import table

from framewitness.operators import compare as C
from framewitness.operators import profile as P


def _compare(spark, current, baseline):
    pair = spark.createDataFrame(
        [(current.dataset_id, baseline.dataset_id)],
        "current_id string, baseline_id string",
    )
    return C.compare(P.profiles([current, baseline]), pair)


def test_schema_and_kind_changes(spark):
    a = table(spark, [(1, "x", 2.0)], "id int, code string, new double", "a")
    b = table(spark, [("1", "x", 3)], "id string, code string, old int", "b")
    row = _compare(spark, a, b).collect()[0]
    assert row.schema.added_columns == ["new"] and row.schema.removed_columns == ["old"]
    assert row.schema.kind_change_count == 1
    assert row.schema.kind_changes[0].asDict() == {
        "column_name": "id", "current_kind": "integer", "baseline_kind": "text",
    }
    assert (row.signal_count, row.compared_column_count) == (3, 2)
    assert row.general.text_column_count_delta == -1


def test_details_are_complete_by_size_then_name(spark):
    names = [f"n{i:02d}" for i in range(25)]
    schema = ", ".join(f"{n} int" for n in names)
    a = table(spark, [tuple(5 if i < 3 else 2 for i in range(25))], schema, "a")
    b = table(spark, [tuple(1 for _ in names)], schema, "b")
    row = _compare(spark, a, b).collect()[0]
    assert row.numbers.columns_with_delta == 25
    shown = [d.column_name for d in row.numbers.details]
    assert shown == names
    assert [d.delta for d in row.numbers.details][:4] == [4.0, 4.0, 4.0, 1.0]


def test_added_names_all_count_as_signals(spark):
    wide = ", ".join(f"n{i:02d} int" for i in range(25))
    a = table(spark, [tuple(range(25))], wide, "a")
    b = table(spark, [(1,)], "other int", "b")
    row = _compare(spark, a, b).collect()[0]
    assert len(row.schema.added_columns) == 25
    assert row.signal_count == 26 and row.compared_column_count == 0
    assert row.nulls.max_absolute_delta == 0.0 and row.numbers.details == []


def test_signed_and_zero_baselines(spark):
    a = table(spark, [(5, 5)], "debt int, none int", "a")
    b = table(spark, [(-10, 0)], "debt int, none int", "b")
    details = {
        d.column_name: d for d in C.details(_compare(spark, a, b), "numbers").collect()
    }
    assert (details["debt"].delta, details["debt"].delta_percentage) == (15.0, -150.0)
    assert details["none"].delta_percentage == 0.0


def test_dates_nulls_categories_and_duplicates(spark):
    schema = "order_id int, day date, status string"
    import datetime as dt

    d = dt.date
    a = table(spark, [(1, d(2026, 1, 1), "x"), (1, d(2026, 1, 4), "x"), (2, None, "x")],
              schema, "a")
    b = table(spark, [(1, d(2026, 1, 1), "x"), (2, d(2026, 1, 2), "y"),
                      (3, d(2026, 1, 3), "x"), (4, d(2026, 1, 4), "y")], schema, "b")
    row = _compare(spark, a, b).collect()[0]
    day = row.dates.details[0]
    assert (day.current_missing_days, day.baseline_missing_days) == (2, 0)
    assert day.range_changed is False and row.dates.columns_with_missing_delta == 1
    assert row.nulls.columns_higher == 1 and row.nulls.max_absolute_delta == 33.33
    status = row.categories.details[0]
    assert (status.unique_count_delta, status.current_high_cardinality) == (-1, False)
    assert row.duplicates.details[0].duplicate_count_delta == 1
    assert row.rows.delta == -1 and row.rows.delta_percentage == -25.0


def test_equal_tables_show_nothing(spark):
    a = table(spark, [(1, "x")], "id int, status string", "a")
    b = table(spark, [(1, "x")], "id int, status string", "b")
    row = _compare(spark, a, b).collect()[0]
    assert row.signal_count == 0
    for section in (row.nulls, row.numbers, row.dates, row.categories, row.duplicates):
        assert section.details == []
    assert set(row.general.asDict().values()) == {0}


def _scans(df) -> dict[str, int]:
    """How often the executed plan reads each column, from its scan nodes."""
    import re
    from collections import Counter

    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    found = Counter()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        found["(scans)"] += 1
        found.update(part.split(":")[0] for part in schema.split(",") if part)
    return found


def test_each_column_is_read_once_per_side(spark):
    from framewitness.catalog.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    for name, sides in (
        ("check_duplicate_keys", 1), ("check_category_shape", 1),
        ("check_date_gaps", 1), ("check_general_profile", 1),
        # both sides are cuts of one table
        ("cmp_dates", 1), ("cmp_numeric", 1), ("cmp_category_shape", 1),
        # the current side is a union of two scans
        ("cmp_duplicates", 3),
    ):
        scans = _scans(QUERIES[name](spark, sf))
        scans.pop("(scans)")
        join_key = scans.pop("doc_id", 0)
        # What the cut of events depends on is read with the columns of each type.
        assert scans.pop("event_type", 0) <= 4
        assert scans and max(scans.values()) <= sides, (name, scans)
        assert join_key <= 2 * sides
    for name, sides in ("check_row_count", 1), ("cmp_row_count", 1):
        scans = _scans(QUERIES[name](spark, sf))
        # Only what a filter needs is read to count rows.
        assert set(scans) <= {"(scans)", "o_orderdate"} and scans["(scans)"] == sides


def test_cuts_of_one_frame_equal_separate_tables(spark):
    from framewitness.operators import profile
    from framewitness.sources.tables import Table

    rows = [
        (i, None if i % 7 == 0 else f"2026-01-{i % 28 + 1:02d}", f"t{i % 5}" * (i % 40), i / 3, i % 2 == 0,
         None if i % 3 == 0 else i)
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "order_id int, day string, label string, x double, ok boolean, s1 int")
    conditions = {"low": "order_id < 120", "all": None, "none": "s1 = -1", "odd": "s1 % 2 = 1"}
    for columnar in (True, False):
        cuts = Table.cuts(df, conditions, columnar=columnar)
        apart = [
            Table.of(df.filter(c or "true"), name, columnar=columnar) for name, c in conditions.items()
        ]
        for measures in (profile.ALL_MEASURES, ("nulls",), ("dates",), ("numeric", "text"), ()):
            one, other = (
                sorted(map(str, profile.profiles(t, measures=measures).collect())) for t in (cuts, apart)
            )
            assert one == other, (columnar, measures)


def test_details_are_complete(spark):
    from framewitness.operators import compare, profile
    from framewitness.sources.tables import Table

    wide = spark.range(3).selectExpr(*[f"id AS extra_{i}" for i in range(30)], "id AS kept")
    sides = [Table.of(wide, "now"), Table.of(wide.select("kept"), "before")]
    pair = spark.createDataFrame([("now", "before")], "current_id string, baseline_id string")
    row = compare.compare(profile.profiles(sides, measures=("nulls",)), pair).first()
    assert len(row["schema"]["added_columns"]) == 30 and row["signal_count"] == 30
