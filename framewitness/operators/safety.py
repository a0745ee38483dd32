"""Guards that keep row content out of every output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewitness.functions.expr import array_of, contains_any, quoted
from framewitness.functions.fixed import BLOCKED_TERMS, FORBIDDEN_FIELDS


# Parts that several of the terms with an underscore have in common.
_SHARED_PARTS = ("_rows", "_values", "value_", "raw_")


def has_blocked_term(text: str) -> str:
    """True when the text holds a blocked term, in any case. Null text: false."""
    return f"coalesce({holds_blocked_term(f'lower({text})')}, false)"


def holds_blocked_term(folded: str) -> str:
    """The same for text already in lower case.

    Each term costs a pass over the text. A term that holds another one is left
    to that one, and terms that share a part are looked for only where the part
    occurs, which changes nothing in the answer.
    """
    terms = [term.lower() for term in BLOCKED_TERMS]
    rest = [t for t in terms if not any(o != t and o in t for o in terms)]
    marked, tests = [], []
    for part in _SHARED_PARTS:
        group = [t for t in rest if part in t]
        rest = [t for t in rest if part not in t]
        marked.append(
            f"contains({folded}, '{part}') AND {contains_any(folded, group)}"
        )
    underscored = [t for t in rest if "_" in t]
    marked.append(contains_any(folded, underscored))
    tests.append(f"contains({folded}, '_') AND ({' OR '.join(marked)})")
    tests.append(contains_any(folded, [t for t in rest if "_" not in t]))
    return f"(({') OR ('.join(tests)}))"


def blocked_terms(text: str) -> str:
    """The blocked terms found, in list order."""
    return (
        f"filter({array_of(BLOCKED_TERMS)}, t -> contains(lower({text}), lower(t)))"
    )


def scan_blocked_terms(df: DataFrame, text_column: str, table_name: str) -> DataFrame:
    """Rows scanned and rows hit; no text leaves the scan."""
    counts = df.agg(
        F.expr("count(1)").alias("rows_scanned"),
        F.expr(f"count_if({has_blocked_term(text_column)})").alias("rows_hit"),
    )
    return counts.selectExpr(
        f"{quoted(table_name)} AS table_name", "rows_scanned", "rows_hit"
    )


def forbidden_fields(data_type: T.DataType) -> list[str]:
    """Field names, at any depth of a schema, that no output may have."""
    found: list[str] = []
    if isinstance(data_type, T.StructType):
        for field in data_type.fields:
            if field.name in FORBIDDEN_FIELDS:
                found.append(field.name)
            found += forbidden_fields(field.dataType)
    elif isinstance(data_type, T.ArrayType):
        found += forbidden_fields(data_type.elementType)
    elif isinstance(data_type, T.MapType):
        found += forbidden_fields(data_type.keyType)
        found += forbidden_fields(data_type.valueType)
    return found


def holds_forbidden_key(value: str, data_type: T.DataType) -> str | None:
    """Whether a value holds a forbidden name as a map key or in JSON text, at any
    depth; None for a type that can't."""
    if isinstance(data_type, T.StringType):
        names = "|".join(FORBIDDEN_FIELDS)
        return f"coalesce({value} RLIKE r'\"({names})\"\\s*:', false)"
    tests = []
    if isinstance(data_type, T.StructType):
        parts = [
            holds_forbidden_key(f"{value}.`{field.name}`", field.dataType)
            for field in data_type.fields
        ]
        tests += [part for part in parts if part]
    elif isinstance(data_type, T.ArrayType):
        inside = holds_forbidden_key("x", data_type.elementType)
        tests += [f"exists({value}, x -> {inside})"] if inside else []
    elif isinstance(data_type, T.MapType):
        if isinstance(data_type.keyType, T.StringType):
            keys = f"arrays_overlap(map_keys({value}), {array_of(FORBIDDEN_FIELDS)})"
            tests.append(f"coalesce({keys}, false)")
        for side, kind in ("keys", data_type.keyType), ("values", data_type.valueType):
            inside = holds_forbidden_key("x", kind)
            tests += [f"exists(map_{side}({value}), x -> {inside})"] if inside else []
    return f"coalesce({' OR '.join(tests)}, false)" if tests else None


def guarded(df: DataFrame) -> DataFrame:
    """The same rows; reading one that holds a forbidden key fails the job."""
    tests = [holds_forbidden_key(f"`{f.name}`", f.dataType) for f in df.schema.fields]
    tests = [test for test in tests if test]
    if not tests:
        return df
    message = "a row holds a field name that must not be written"
    found = f"IF({' OR '.join(tests)}, raise_error('{message}'), true)"
    return df.filter(found)
