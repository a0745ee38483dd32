"""States that add up to the state of the whole, and estimates within their bound."""

from __future__ import annotations

import random

import pytest
from helpers import table

from framewitness.operators import profile as P
from framewitness.operators import sketches as S
from framewitness.sources import stage_table

SCHEMA = "id int, day string, label string, x double, amount decimal(12,2), ok boolean, tags array<int>"


def rows(many, seed=3):
    draw = random.Random(seed)
    return [
        (
            i, None if i % 9 == 0 else f"2026-0{i % 3 + 1}-{i % 28 + 1:02d}", f"text {i % 700}" + "y" * 90 * (i % 2),
            float("nan") if i % 11 == 0 else draw.choice([0.0, -0.0, i / 7]), None, i % 2 == 0, [i % 5],
        )
        for i in range(many)
    ]


def by_column(df):
    return {r.column_name: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def whole(spark):
    return table(spark, rows(20_000), SCHEMA)


def test_estimates_within_their_bound(spark, whole):
    exact, found = by_column(P.column_profile(whole)), by_column(S.finished(S.state(whole)))
    estimated = {"unique_count", "unique_percentage", "duplicate_value_count"}
    for name, row in exact.items():
        assert {k: v for k, v in row.items() if k not in estimated} == pytest.approx(
            {k: v for k, v in found[name].items() if k not in estimated}
        ), name
        off = abs(found[name]["unique_count"] - row["unique_count"])
        assert off <= S.unique_error() * row["unique_count"], name


def test_halves_that_are_merged_equal_the_whole(spark, whole, tmp_path):
    parts = [
        table(spark, part, SCHEMA) for part in (rows(20_000)[:3], rows(20_000)[3:12_000], rows(20_000)[12_000:], [])
    ]
    # Yesterday's state is written, and today's is added to it.
    kept = stage_table(S.merged(S.state(part) for part in parts[:2]), str(tmp_path), "state")
    added = S.merged([kept, *map(S.state, parts[2:])])
    found, want = by_column(S.finished(added)), by_column(S.finished(S.state(whole)))
    for name, row in want.items():
        assert found[name] == pytest.approx(row), name
        assert found[name]["unique_count"] == row["unique_count"]


def test_empty_table_maps_and_smaller_sketches(spark):
    empty = by_column(S.finished(S.state(table(spark, [], "a int, b string"))))
    assert empty["a"]["row_count"] == 0 == empty["b"]["unique_count"]
    maps = table(spark, [({"a": 1}, 1)], "m map<string,int>, n int")
    found = by_column(S.finished(S.state(maps, log_size=8)))
    assert found["m"]["unique_count"] is None and found["n"]["unique_count"] == 1
    assert found["m"]["non_null_count"] == 1
    twice = by_column(S.finished(S.merged([S.state(maps), S.state(maps)])))
    assert twice["m"]["unique_count"] is None and twice["m"]["row_count"] == 2
    assert twice["n"]["unique_count"] == 1
