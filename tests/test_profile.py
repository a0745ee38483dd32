from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from helpers import BASELINE, CURRENT, SCHEMA, by_name, table

from framewitness import Table
from framewitness.operators import profile as P


@pytest.mark.parametrize("columnar", [True, False])
def test_golden_profile(spark, columnar):
    now = by_name(
        P.column_profile(table(spark, CURRENT, SCHEMA, columnar=columnar))
    )
    key, email, date, worth = (
        now[n] for n in ("customer_id", "email", "signup_date", "worth")
    )
    assert (key.unique_count, key.duplicate_value_count) == (11, 1)
    assert (email.null_count, email.null_percentage, email.unique_count) == (2, 16.67, 10)
    assert email.inferred_kind == "text" and email.txt_avg_len == 13.0
    assert date.inferred_kind == "datetime" and date.dt_parsed_count == 12
    assert date.dt_min == "2026-05-20T00:00:00"
    assert (date.dt_day_count, date.dt_expected_days, date.dt_missing_days) == (6, 6, 0)
    assert worth.inferred_kind == "decimal"
    assert (worth.num_min, worth.num_max) == (0.0, 510.1)
    assert round(worth.num_total, 2) == 1721.80
    assert now["status"].unique_count == 3 and now["region"].unique_count == 4
    assert key.num_total is None and worth.txt_min_len is None


def test_measures_only_what_is_asked(spark):
    t = table(spark, CURRENT, SCHEMA)
    rows = by_name(P.column_profile(t, measures=("nulls",), columns=["email", "status"]))
    assert set(rows) == {"email", "status"}
    assert rows["email"].null_count == 2 and rows["email"].unique_count is None
    with pytest.raises(ValueError):
        P.column_profile(t, measures=("medians",))
    with pytest.raises(ValueError):
        P.column_profile(t, columns=["absent"])


@pytest.mark.parametrize("columnar", [True, False])
def test_floats_count_nan_as_null(spark, columnar):
    rows = [(float("nan"),), (None,), (0.0,), (-0.0,), (2.5,)]
    x = by_name(
        P.column_profile(table(spark, rows, "x double", columnar=columnar))
    )["x"]
    assert (x.row_count, x.non_null_count, x.unique_count) == (5, 3, 2)
    assert (x.num_total, x.num_max) == (2.5, 2.5)


@pytest.mark.parametrize("columnar", [True, False])
def test_every_type_has_a_kind(spark, columnar):
    schema = (
        "flag boolean, small smallint, big bigint, money decimal(10,2), day date,"
        " at timestamp, ntz timestamp_ntz, raw binary, list array<int>,"
        " pairs map<string,int>, gone string"
    )
    at = dt.datetime(2024, 3, 1, 10, 30, 0, 5)
    row = (
        True, 1, 7, Decimal("1.50"), dt.date(2024, 3, 1), at, at, bytearray(b"ab"),
        [1, 2], {"a": 1}, None,
    )
    again = (
        None, 2, 7, Decimal("2.50"), dt.date(2024, 3, 4), at, at, bytearray(b"ab"),
        [1, 2], {"a": 1}, None,
    )
    t = table(spark, [row, again], schema, columnar=columnar)
    rows = by_name(P.column_profile(t))
    kinds = {name: r.inferred_kind for name, r in rows.items()}
    assert kinds == {
        "flag": "boolean", "small": "integer", "big": "integer", "money": "decimal",
        "day": "datetime", "at": "datetime", "ntz": "datetime",
        "raw": "mixed_or_unknown", "list": "mixed_or_unknown",
        "pairs": "mixed_or_unknown", "gone": "empty",
    }
    assert [rows[n].unique_count for n in ("flag", "small", "big", "money")] == [1, 2, 1, 2]
    assert [rows[n].unique_count for n in ("raw", "list", "pairs", "gone")] == [1, 1, 1, 0]
    assert rows["flag"].num_total == 1.0 and rows["flag"].num_min is None
    assert rows["money"].num_total == 4.0
    assert rows["day"].dt_missing_days == 2
    assert rows["ntz"].dt_min == "2024-03-01T10:30:00.000005"


def test_variant_has_counts_but_no_unique(spark):
    df = spark.sql("SELECT parse_json('1') AS v UNION ALL SELECT NULL")
    v = by_name(P.column_profile(Table.of(df, "t", columnar=True)))["v"]
    assert (v.non_null_count, v.null_count, v.unique_count) == (1, 1, None)


@pytest.mark.parametrize("measures", [P.ALL_MEASURES, ("nulls", "dates"), ("nulls",)])
def test_empty_table_keeps_its_columns(spark, measures):
    t = table(spark, [], "a int, b string")
    rows = by_name(P.column_profile(t, measures=measures))
    assert {r.inferred_kind for r in rows.values()} == {"empty"}
    assert rows["a"].row_count == 0 and rows["a"].null_percentage == 0.0


@pytest.mark.parametrize("share, kind", [(79, "text"), (80, "datetime"), (81, "datetime")])
def test_date_share_decides_the_kind(spark, share, kind):
    rows = [("2026-01-02",)] * share + [("soon",)] * (100 - share)
    for measures in (P.ALL_MEASURES, ("dates",)):
        got = by_name(P.column_profile(table(spark, rows, "d string"), measures=measures))
        assert got["d"].inferred_kind == kind
        assert got["d"].dt_day_count == 1


def test_only_whole_dates_parse_in_any_order(spark):
    good = ["2026-01-01", "2026-01-02 10:00", "2026-01-03T10:00:01.25"]
    bad = ["2026", "2026-01", "999999", "10:30", "today", " 2026-01-01 ", "2026-02-30",
           "24:00:00", "2026-01-01T10:00Z", "20260101", ""]
    rows = [(x,) for x in good + bad]
    found = set()
    for order in (rows, rows[::-1]):
        for parts in (1, 7):
            df = spark.createDataFrame(order, "d string").repartition(parts)
            d = by_name(P.column_profile(Table.of(df, "t")))["d"]
            found.add((d.day_min, d.day_max, d.dt_day_count, d.inferred_kind))
    assert found == {("2026-01-01", "2026-01-03", 3, "text")}
    extra = P.column_profile(table(spark, rows, "d string"), date_formats=("yyyyMMdd",))
    assert by_name(extra)["d"].dt_day_count == 3


def test_date_named_numbers_are_epoch_nanoseconds(spark):
    rows = [(2020, -1.0, 5), (2021, 1.7e18, 5), (None, 1e30, 5)]
    schema = "year bigint, time double, plain int"
    for columnar in (True, False):
        for measures in (P.ALL_MEASURES, ("dates",)):
            t = table(spark, rows, schema, columnar=columnar)
            got = by_name(P.column_profile(t, measures=measures))
            assert got["year"].day_min == got["year"].day_max == "1970-01-01"
            assert (got["time"].day_min, got["time"].day_max) == ("1969-12-31", "2023-11-14")
            assert got["plain"].day_min is None
            assert got["year"].inferred_kind == "integer" and got["year"].dt_min is None


def test_long_texts_are_told_apart(spark):
    rows = [("x" * 5000 + str(i % 3),) for i in range(30)] + [("x" * 64,), ("x" * 65,)]
    for columnar in (True, False):
        t = table(spark, rows, "body string", columnar=columnar)
        body = by_name(P.column_profile(t))["body"]
        assert (body.unique_count, body.txt_min_len, body.txt_max_len) == (5, 64, 5001)


def test_repeated_and_blank_names(spark):
    names = ["a", "b", "a", "", "Unnamed: 3", "_c7", " "]
    t = table(spark, [(1, 2, None, 4, 5, 6, 7)], ", ".join(f"x{i} int" for i in range(7)),
              names=names)
    profile = P.column_profile(t)
    found = {r.column_name: r for r in P.duplicate_names(profile).collect()}
    assert set(found) == {"a", "", "Unnamed: 3", "_c7", " "}
    assert found["a"].occurrences == 2 and not found["a"].is_empty_name
    summary = P.table_summary(profile).collect()[0]
    assert summary.duplicate_column_name_count == 1
    assert summary.empty_column_name_count == 4
    assert summary.total_null_cells == 1 and summary.column_count == 7


def test_names_with_quotes_survive(spark):
    names = ["it's", "back\\slash", 'dou"ble']
    t = table(spark, [(1, 2, 3)], "a int, b int, c int", names=names)
    assert set(by_name(P.column_profile(t))) == set(names)


def test_one_value_in_a_third_of_all_rows(spark):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, id) AS hot_id")
    hot = by_name(P.column_profile(Table.of(df, "t", columnar=True)))["hot_id"]
    assert (hot.unique_count, hot.duplicate_value_count) == (2001, 999)


def test_counts_add_up_and_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(CURRENT + BASELINE, SCHEMA)
    seen = set()
    for parts in (1, 3, 11):
        rows = P.column_profile(Table.of(df.repartition(parts), "t")).collect()
        for r in rows:
            assert r.non_null_count + r.null_count == r.row_count
            assert r.unique_count <= r.non_null_count
        # Float totals may differ in the last bits with the order of addition.
        seen.add(tuple(sorted((r.column_name, r.unique_count, r.dt_min) for r in rows)))
    assert len(seen) == 1


def test_many_tables_in_one_profile(spark):
    a = table(spark, [(1,)], "x int", "a")
    b = table(spark, [("q",), (None,)], "x string", "b", columnar=False)
    rows = {r.dataset_id: r for r in P.profiles([a, b]).collect()}
    assert rows["a"].inferred_kind == "integer" and rows["b"].inferred_kind == "text"
    kinds = {(r.dataset_id, r.inferred_kind): r.column_count
             for r in P.kind_counts(P.profiles([a, b])).collect()}
    assert kinds == {("a", "integer"): 1, ("b", "text"): 1}


def test_only_asked_columns_are_scanned(spark):
    path = "/root/testdata/sf0.001/lineitem.parquet"
    from framewitness import read_parquet

    t = read_parquet(spark, path, "lineitem")
    plan = P.column_profile(t, columns=["l_orderkey"], measures=("unique",))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in text


def test_filters_reach_the_scan(spark):
    from framewitness.catalog import inputs

    recent, _ = inputs.orders_by_date(spark, "/root/testdata/sf0.001")
    plan = P.column_profile(recent, columns=["o_totalprice"], measures=("numeric",))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text
