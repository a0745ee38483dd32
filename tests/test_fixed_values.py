"""The fixed values, spelled out once more, so that a wrong one can't agree with itself.

The DuckDB statements take the lists from the library; these copies were typed from the
rules that are matched.
"""

from __future__ import annotations

from framewitness.functions import fixed

TERMS = {
    "schema_change": "schema|column missing|missing column|new column|removed column"
    "|field missing|missing field|header changed",
    "duplicate_key": "duplicate|duplicated|duplicating|repeating|repeated|same id"
    "|duplicate id|duplicate key",
    "null_increase": "null|nulls|blank|missing value|empty field|blank more often"
    "|missing email|increased nulls",
    "date_gap": "gap|missing date|missing day|date gap|no records for date"
    "|no records for one day|missing period",
    "total_change": "total|sum|dropped|increased|decreased|report total|count changed"
    "|row count changed|volume changed",
    "category_shift": "category|status|segment|region|value spiked|spiked|disappeared"
    "|distribution|mix changed",
}
PRECEDENCE = (
    "schema_change duplicate_key null_increase date_gap total_change category_shift"
    " general_suspected_issue"
)


def test_terms_and_their_precedence():
    assert {k: "|".join(v) for k, v in fixed.ISSUE_TERMS.items()} == TERMS
    assert " ".join(fixed.ISSUE_PRECEDENCE) == PRECEDENCE


def test_words_of_names_and_stop_words():
    assert " ".join(fixed.KEY_TERMS) == "id key code number reference ref"
    assert " ".join(fixed.DATE_TERMS) == "date time timestamp period day month year"
    assert " ".join(fixed.CATEGORY_TERMS) == "status category type segment region"
    assert " ".join(fixed.TOTAL_TERMS) == "total amount value count quantity qty volume"
    stop = "a an and are field fields has have in the to with started increased decreased"
    assert " ".join(fixed.STOP_WORDS) == stop + " missing null nulls blank empty"


def test_routes_checks_and_limits():
    routes = [*TERMS]
    assert {t: fixed.ROUTE_NAMES[t] for t in routes} == {t: f"{t}_investigation" for t in routes}
    assert fixed.ROUTE_NAMES["general_suspected_issue"] == "general_investigation"
    assert [len(fixed.PLANNED_CHECKS[t]) for t in routes] == [3] * 6
    assert len(fixed.PLANNED_CHECKS["general_suspected_issue"]) == 2
    assert (len(fixed.BLOCKED_TERMS), len(fixed.FORBIDDEN_FIELDS)) == (28, 16)
    assert (fixed.CATEGORY_SHARE_LIMIT, fixed.DATE_PARSE_SHARE) == (50.0, 80.0)
    assert (fixed.NOTE_SUMMARY_CHARS, fixed.NOTE_LIST_ITEMS, fixed.NOTE_ITEM_CHARS) == (1000, 8, 300)


def test_folding_is_that_of_unicode():
    every = {chr(c) for c in range(0x110000)}
    odd = {
        c: c.casefold()
        for c in every
        if c.lower() == c != c.casefold() and any(x.isascii() for x in c.casefold())
    }
    assert fixed.FOLDS == odd
