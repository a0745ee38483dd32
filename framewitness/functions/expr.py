"""Expression texts used by every operator.

Each helper returns Spark SQL text. A profile of a wide table has thousands of
expressions; as text they reach Catalyst in a handful of calls, and every one of
them is a built-in: there are no UDFs.
"""

from __future__ import annotations

import re

from framewitness.functions.fixed import BLANK_PATTERN, DATE_TEXT_PATTERN, FOLDS

_NANOS_PER_DAY = 86_400_000_000_000
_NANOS_LIMIT = "9.2E18D"


def quoted(text: str | None) -> str:
    """A string literal."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return quoted(value)


def array_of(values) -> str:
    """A literal array<string>, typed even when it is empty."""
    return f"CAST(array({', '.join(literal(v) for v in values)}) AS ARRAY<STRING>)"


def pct(numerator: str, denominator: str) -> str:
    """Percentage at two decimals; 0.0 whenever the denominator is zero."""
    share = f"try_divide(double({numerator}), double({denominator}))"
    return f"CASE WHEN {denominator} = 0 THEN 0.0D ELSE round({share} * 100, 2) END"


def parse_timestamp(text: str, formats: tuple[str, ...] = ()) -> str:
    """Parse each string on its own, so the result cannot depend on row order.

    Only full ISO dates and date-times pass the guard; Spark alone would also
    accept a bare year or a bare time. Extra formats are tried in turn on what
    is left. The result is zone-free.
    """
    guarded = f"CASE WHEN {text} RLIKE r'{DATE_TEXT_PATTERN}' THEN {text} END"
    parsed = f"try_cast({guarded} AS TIMESTAMP_NTZ)"
    extra = [
        f"CAST(try_to_timestamp({text}, {quoted(f)}) AS TIMESTAMP_NTZ)" for f in formats
    ]
    return f"coalesce({', '.join([parsed, *extra])})" if extra else parsed


def epoch_nanos_to_date(value: str, *, whole: bool) -> str:
    """Day of a number read as nanoseconds since 1970-01-01.

    This is how date-named numeric columns are read by the date checks.
    """
    if whole:
        nanos = f"bigint({value})"
        borrow = f"IF({nanos} % {_NANOS_PER_DAY} < 0, 1, 0)"
        days = f"({nanos} DIV {_NANOS_PER_DAY} - {borrow})"
    else:
        number = f"double({value})"
        in_range = f"abs({number}) < {_NANOS_LIMIT}"
        days = f"CASE WHEN {in_range} THEN floor({number} / {_NANOS_PER_DAY}) END"
    return f"date_add(DATE'1970-01-01', int({days}))"


def iso_timestamp(value: str) -> str:
    """ISO text of a zone-free timestamp; a fraction, if any, has six digits."""
    text = f"replace(string({value}), ' ', 'T')"
    return f"IF(contains({text}, '.'), rpad({text}, 26, '0'), {text})"


def iso_date(value: str) -> str:
    """ISO text of a date."""
    return f"string({value})"


def is_blank(text: str) -> str:
    return f"({text} IS NULL OR {text} RLIKE r'{BLANK_PATTERN}')"


def contains_any(text: str, terms) -> str:
    """True when the text holds any of the (already lower-case) terms.

    ``text`` is repeated per term, so it should be a plain column or variable.
    """
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


def fold(lowered: str) -> str:
    """Full case folding of a lower-case column, as far as ASCII letters come of it.

    ``lowered`` is repeated, so it should be a plain column.
    """
    out = lowered
    for letter, folded in FOLDS.items():
        out = f"replace({out}, {quoted(letter)}, {quoted(folded)})"
    plain = f"octet_length({lowered}) = char_length({lowered})"
    return f"IF({plain} OR NOT {lowered} RLIKE '[{''.join(FOLDS)}]', {lowered}, {out})"


def terms_pattern(terms) -> str:
    """A pattern that captures, at each place, the longest term that begins there.

    The terms are laid out as a tree of their letters, so a place is left at the first
    letter that no term has. The match itself is empty: terms that overlap are all found.
    """

    def branches(tails: set[str]) -> str:
        heads = sorted({tail[0] for tail in tails if tail})
        parts = [re.escape(head) + branches({t[1:] for t in tails if t[:1] == head}) for head in heads]
        if not parts:
            return ""
        if len(parts) == 1 and "" not in tails:
            return parts[0]
        return f"(?:{'|'.join(parts)})" + ("?" if "" in tails else "")

    heads = "".join(sorted({re.escape(term[0]) for term in terms}))
    return f"(?=[{heads}])(?=({branches(set(terms))}))"


def total(array: str) -> str:
    """Sum of an array<bigint>; 0 for an empty one."""
    return f"aggregate({array}, 0L, (acc, x) -> acc + x)"


def most(array: str) -> str:
    """Largest entry of an array<bigint>; 0 for an empty one."""
    return f"coalesce(array_max({array}), 0L)"


def pick(array: str, field: str) -> str:
    """One field of every struct in an array."""
    return f"transform({array}, e -> e.{field})"


def struct_of(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def unnest(df, array: str, key: str, *kept: str):
    """One row per struct of an array column; ``key`` is a field never null.

    The outer form keeps Catalyst from deriving a size filter, which it would
    push below the projections by repeating the whole expression of the array.
    """
    return df.selectExpr(*kept, f"inline_outer({array})").filter(f"{key} IS NOT NULL")
