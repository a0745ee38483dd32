"""Column profile: one row of aggregates per column, never a value.

Three physical shapes produce the same measures:

* no unique counts asked for: one wide aggregate, nothing shuffled but one row per
  task; columns that may hold dates are grouped by day first. Either way a column is
  read once, and a source that is not columnar is read in a single pass;
* unique counts over a columnar source: the columns of one type are read together
  and grouped as (position, value) rows, so every column is read once, a shuffled
  row is one value and one count, and a wide table needs no more jobs;
* unique counts over anything else (a join, text files): one pass over the source
  that lays all columns out as (position, value) rows and groups those.

Tables that are cuts of one frame (``Table.cuts``) are read in the same passes, with the
column of each side as a key of its own.

In the last two every further measure is computed from the grouped values, so
parsing and length work is done once per different value. A value that fills a
third of the table collapses in the map-side aggregation. Long strings are
grouped by their SHA-256 digest, so whole texts are never shuffled; a date in them is
parsed from the text itself.

Whole numbers and decimals are added and compared exactly, as whole numbers of their
last digit.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewitness.functions.expr import (
    epoch_nanos_to_date,
    iso_date,
    iso_timestamp,
    literal,
    parse_timestamp,
    pct,
    quoted,
    struct_of,
)
from framewitness.functions.fixed import DATE_PARSE_SHARE, DATE_TERMS
from framewitness.sources.tables import Table

ALL_MEASURES = frozenset({"nulls", "unique", "numeric", "dates", "text"})

# Strings up to this many bytes are grouped as they are; longer ones by digest.
_SHORT_TEXT_BYTES = 64

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DECIMALS = (T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Raw measures of each group, with their types.
_RAW = {
    "unique": {"unique_count": "BIGINT"},
    "numeric": {
        "num_min": "DOUBLE",
        "num_max": "DOUBLE",
        "num_sum": "DOUBLE",
        "exact_min": "DECIMAL(38,0)",
        "exact_max": "DECIMAL(38,0)",
        "exact_sum": "DECIMAL(38,0)",
    },
    "text": {"len_min": "BIGINT", "len_max": "BIGINT", "len_sum": "BIGINT"},
    "dates": {
        "parsed_count": "BIGINT",
        "moment_min": "TIMESTAMP_NTZ",
        "moment_max": "TIMESTAMP_NTZ",
        "day_min": "DATE",
        "day_max": "DATE",
        "day_count": "BIGINT",
    },
}


def _base_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, _INTEGERS):
        return "integer"
    if isinstance(data_type, _DECIMALS):
        return "decimal"
    if isinstance(data_type, _DATES):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    return "mixed_or_unknown"


def _is_number(data_type: T.DataType) -> bool:
    return _base_kind(data_type) in ("boolean", "integer", "decimal")


def _text_key(text: str) -> str:
    """Grouping key of a string: itself if short, else a longer digest text.

    A digest key is longer than any short key, so the two can never meet.
    """
    short = f"octet_length({text}) <= {_SHORT_TEXT_BYTES}"
    return f"CASE WHEN {short} THEN {text} ELSE 'sha256:' || sha2({text}, 256) END"


@dataclass(frozen=True)
class _Source:
    """What is known about a column before any job runs.

    ``id`` numbers the profiled columns of all tables of one profile.
    """

    id: int
    table: Table
    position: int

    @property
    def name(self) -> str:
        return self.table.names[self.position]

    @property
    def data_type(self) -> T.DataType:
        return self.table.frame.schema.fields[self.position].dataType

    @property
    def kind(self) -> str:
        return _base_kind(self.data_type)

    @property
    def is_text(self) -> bool:
        return self.kind == "string"

    @property
    def is_number(self) -> bool:
        return _is_number(self.data_type)

    @property
    def is_date_named_number(self) -> bool:
        name = self.name.lower()
        return self.kind in ("integer", "decimal") and any(
            term in name for term in DATE_TERMS
        )

    @property
    def may_hold_dates(self) -> bool:
        return self.kind in ("string", "datetime") or self.is_date_named_number

    @property
    def comparable(self) -> bool:
        return not isinstance(self.data_type, T.VariantType)

    def value(self) -> str:
        """The column; a float that is NaN counts as null."""
        name = f"c{self.position}"
        if isinstance(self.data_type, (T.FloatType, T.DoubleType)):
            return f"IF(isnan({name}), NULL, {name})"
        return name

    def number(self, value: str) -> str:
        if self.kind == "boolean":
            return f"double(int({value}))"
        return f"double({value})" if self.is_number else "CAST(NULL AS DOUBLE)"

    @property
    def scale(self) -> int | None:
        """Digits after the point of a number that is kept exactly."""
        if self.kind == "integer":
            return 0
        kind = self.data_type
        if isinstance(kind, T.DecimalType) and kind.precision + kind.scale <= 37:
            return kind.scale
        return None

    def exact(self, value: str) -> str:
        """A number as a whole number of its last digit."""
        if self.scale is None:
            return "CAST(NULL AS DECIMAL(38,0))"
        shifted = f"{value} * {10 ** self.scale}BD" if self.scale else value
        return f"CAST({shifted} AS DECIMAL(38,0))"

    def counted(self, asked) -> bool:
        """Whether its cells are counted: if that is asked for, or comes for free."""
        return (
            "nulls" in asked
            or ("numeric" in asked and self.is_number)
            or ("text" in asked and self.is_text)
            or ("dates" in asked and self.may_hold_dates)
        )

    def moment(self, value: str, formats: tuple[str, ...]) -> str:
        if self.kind == "datetime":
            return f"CAST({value} AS TIMESTAMP_NTZ)"
        if self.is_text:
            return parse_timestamp(value, formats)
        return "CAST(NULL AS TIMESTAMP_NTZ)"

    def day(self, value: str, moment: str) -> str:
        if self.is_date_named_number:
            return epoch_nanos_to_date(value, whole=self.kind == "integer")
        return moment


def _whole(table: Table) -> DataFrame:
    """What is scanned for a table: the frame that it is a cut of, if it is one."""
    return table.frame if table.origin is None else table.origin


def _laid_out(sources: list[_Source], row) -> str:
    """The structs of a row's columns; those of a cut only where the row belongs to it."""
    parts = []
    for table, members in _by_table(sources):
        own = f"array({', '.join(map(row, members))})"
        parts.append(own if table.side is None else f"IF({table.side}, {own}, NULL)")
    if len(parts) == 1 and sources[0].table.side is None:
        return f"inline({parts[0]})"
    return f"inline(flatten(array_compact(array({', '.join(parts)}))))"


def _wide(table: Table, sources: list[_Source], asked) -> DataFrame:
    """Counts, numbers and lengths: one aggregate over the raw rows."""
    structs = []
    for source in sources:
        value, side = source.value(), source.table.side
        among = f" FILTER (WHERE {side})" if side else ""
        cells = f"count({value}){among}" if source.counted(asked) else "CAST(NULL AS BIGINT)"
        fields = {
            "id": str(source.id), "row_count": f"count(1){among}", "non_null_count": cells,
        }
        if "numeric" in asked:
            number, exact = source.number(value), source.exact(value)
            for name, call in ("min", "min"), ("max", "max"), ("sum", "try_sum"):
                wanted = source.is_number
                fields[f"num_{name}"] = f"{call}({number}){among}" if wanted else number
                wanted = source.scale is not None
                measure = f"{call}({exact}){among}" if wanted else exact
                fields[f"exact_{name}"] = f"CAST({measure} AS DECIMAL(38,0))"
        if "text" in asked:
            for name in ("min", "max", "sum"):
                measure = f"{name}(length({value})){among}" if source.is_text else "NULL"
                fields[f"len_{name}"] = f"CAST({measure} AS BIGINT)"
        structs.append(struct_of(**fields))
    wide = _whole(table).agg(F.expr(f"array({', '.join(structs)})").alias("rows"))
    return wide.selectExpr("inline(rows)")


def _by_day(table: Table, sources: list[_Source], asked, formats) -> DataFrame:
    """The same measures and those of dates, in one pass over the columns given.

    Rows are grouped by column and day before they meet, so the shuffle carries at most
    one row per column, day and task.
    """

    def row(source: _Source) -> str:
        value = source.value()
        moment = source.moment(value, formats)
        fields = {
            "id": str(source.id),
            "present": f"{value} IS NOT NULL",
            "moment": moment,
            "day": f"date({source.day(value, moment)})",
        }
        if "numeric" in asked:
            fields |= {"number": source.number(value), "exact": source.exact(value)}
        if "text" in asked:
            length = f"length({value})" if source.is_text else "NULL"
            fields["length"] = f"CAST({length} AS BIGINT)"
        return struct_of(**fields)

    first = {
        "n": "count(1)",
        "cells": "count_if(present)",
        "first": "min(moment)",
        "last": "max(moment)",
    }
    last = {
        "row_count": "sum(n)",
        "non_null_count": "sum(cells)",
        "parsed_count": "coalesce(sum(IF(day IS NOT NULL, n, 0)), 0)",
        "moment_min": "min(first)",
        "moment_max": "max(last)",
        "day_min": "min(day)",
        "day_max": "max(day)",
        "day_count": "count(day)",
    }
    slots = [("numeric", "number", "num"), ("numeric", "exact", "exact"), ("text", "length", "len")]
    for group, slot, name in slots:
        if group in asked:
            for call in ("min", "max", "sum"):
                added = f"try_sum({slot})" if call == "sum" else f"{call}({slot})"
                kind = _RAW[group][f"{name}_{call}"]
                first[f"{name}_{call}"] = f"CAST({added} AS {kind})"
                again = "try_sum" if call == "sum" else call
                last[f"{name}_{call}"] = f"CAST({again}({name}_{call}) AS {kind})"
    cells = _whole(table).selectExpr(_laid_out(sources, row))
    found = cells.groupBy("id", "day").agg(*_named(first))
    # A row per column keeps the columns of an empty table in the result.
    spark = table.frame.sparkSession
    ids = ", ".join(str(source.id) for source in sources)
    anchor = spark.range(1).selectExpr(f"explode(array({ids})) AS id").selectExpr(
        "id", "0L AS n", "0L AS cells"
    )
    return found.unionByName(anchor, allowMissingColumns=True).groupBy("id").agg(
        *_named(last)
    )


def _with_row_counts(found: DataFrame, dated: list[_Source], plain: list[_Source]):
    """Rows for columns of which nothing but the table's row count is asked."""
    others = {table.dataset_id: members for table, members in _by_table(plain)}
    whens = []
    for table, (first, *_) in _by_table(dated):
        ids = [first.id, *(s.id for s in others.get(table.dataset_id, ()))]
        whens.append(f"WHEN {first.id} THEN array({', '.join(map(str, ids))})")
    measures = [c for c in found.columns if c not in ("id", "row_count")]
    return found.selectExpr(
        f"explode(CASE id {' '.join(whens)} ELSE array(id) END) AS own", "*"
    ).selectExpr(
        "own AS id", "row_count", *[f"IF(own = id, {c}, NULL) AS {c}" for c in measures]
    )


def _named(measures: dict[str, str]) -> list:
    return [F.expr(text).alias(name) for name, text in measures.items()]


def _ungrouped(sources: list[_Source], asked, formats) -> DataFrame:
    parts = []
    for table, members in _by_scan(sources):
        dated = [s for s in members if "dates" in asked and s.may_hold_dates]
        if dated and not table.columnar:
            dated = members  # a source that is read whole is read once
        plain = [s for s in members if s not in dated]
        if dated and plain and not any(s.counted(asked) for s in plain):
            days = _by_day(table, dated, asked, formats)
            parts.append(_with_row_counts(days, dated, plain))
            continue
        if plain:
            parts.append(_wide(table, plain, asked))
        if dated:
            parts.append(_by_day(table, dated, asked, formats))
    known = {"id", "row_count", "non_null_count"}.union(*(set(p.columns) for p in parts))
    every = {name: type_ for group in _RAW.values() for name, type_ in group.items()}
    order = ["id", "row_count", "non_null_count", *[n for n in every if n in known]]
    typed = [
        part.select(
            *[
                F.col(n) if n in part.columns else F.lit(None).cast(every[n]).alias(n)
                for n in order
            ]
        )
        for part in parts
    ]
    return reduce(DataFrame.unionByName, typed)


def _by_table(sources: list[_Source]) -> list[tuple[Table, list[_Source]]]:
    groups: dict[str, tuple[Table, list[_Source]]] = {}
    for source in sources:
        entry = groups.setdefault(source.table.dataset_id, (source.table, []))
        entry[1].append(source)
    return list(groups.values())


def _by_scan(sources: list[_Source]) -> list[tuple[Table, list[_Source]]]:
    """Columns of tables that are read in one pass: cuts of one frame belong together."""
    groups: dict[int | str, tuple[Table, list[_Source]]] = {}
    for source in sources:
        table = source.table
        key = table.dataset_id if table.origin is None else id(table.origin)
        groups.setdefault(key, (table, []))[1].append(source)
    return list(groups.values())


def _cell(id_, n, present, number, exact, length, moment, day) -> list[str]:
    return [
        f"int({id_}) AS id",
        f"bigint({n}) AS n",
        f"{present} AS present",
        f"double({number}) AS number",
        f"CAST({exact} AS DECIMAL(38,0)) AS exact",
        f"bigint({length}) AS length",
        f"CAST({moment} AS TIMESTAMP_NTZ) AS moment",
        f"date({day}) AS day",
    ]


def _cells_of_column(table: Table, source: _Source, asked, formats) -> DataFrame:
    """One row per different value of one column, with its number of cells."""
    value = source.value() if source.comparable else f"{source.value()} IS NOT NULL"
    grouped = table.frame.selectExpr(f"{value} AS key").groupBy("key")
    dated = "dates" in asked
    moment = source.moment("key", formats) if dated else "NULL"
    day = source.day("key", moment) if dated else "NULL"
    return grouped.agg(F.expr("count(1)").alias("n")).selectExpr(
        *_cell(
            source.id,
            "n",
            "key IS NOT NULL" if source.comparable else "key",
            source.number("key"),
            source.exact("key"),
            "NULL",
            moment,
            day,
        )
    )


def _family(source: _Source, columnar: bool) -> str | None:
    """Columns that can be grouped together, by the type their values share."""
    data_type, kind = source.data_type, source.kind
    if kind == "mixed_or_unknown":
        return None
    if not columnar:
        return "any"
    if isinstance(data_type, (T.DecimalType, T.TimestampType)):
        return None
    families = {"boolean": "whole", "integer": "whole", "decimal": "real"}
    return families.get(kind, "text" if source.is_text else "clock")


def _cells_of_family(
    table: Table, sources: list[_Source], family: str, asked, formats
) -> DataFrame:
    """One row per column and different value, for columns of one type."""
    types = {"whole": "BIGINT", "real": "DOUBLE", "clock": "TIMESTAMP_NTZ"}

    is_text = family == "text"
    # Without further formats only short texts can be dates, and those are their keys.
    dated = is_text and "dates" in asked and bool(formats)
    def row(source: _Source) -> str:
        value, fields = source.value(), {"id": str(source.id)}
        if family == "text":
            fields["key"] = _text_key(value)
            fields["size"] = f"length({value})"
            if dated:
                fields["moment"] = parse_timestamp(value, formats)
        else:
            fields["key"] = f"CAST({value} AS {types[family]})"
        return struct_of(**fields)

    numeric = family in ("whole", "real")
    moment = day = "NULL"
    if dated:
        moment = day = "moment"
    elif "dates" in asked and is_text:
        moment = day = parse_timestamp("key", formats)
    elif "dates" in asked and family == "clock":
        moment = day = "key"
    elif "dates" in asked:
        named = [str(s.id) for s in sources if s.is_date_named_number]
        if named:
            read = epoch_nanos_to_date("key", whole=family == "whole")
            day = f"IF(id IN ({', '.join(named)}), {read}, NULL)"
    return (
        _whole(table).selectExpr(_laid_out(sources, row))
        .groupBy("id", "key", *(["size"] if is_text else []), *(["moment"] if dated else []))
        .agg(F.expr("count(1)").alias("n"))
        .selectExpr(
            *_cell(
                "id",
                "n",
                "key IS NOT NULL",
                "key" if numeric else "NULL",
                "key" if family == "whole" else "NULL",
                "size" if is_text else "NULL",
                moment,
                day,
            )
        )
    )


def _cells_in_one_pass(
    table: Table, sources: list[_Source], asked, formats
) -> DataFrame:
    """The same rows for all columns together, from a single pass.

    Each column fills the slots its type needs; rows stay narrow however many
    columns there are.
    """

    def slots(source: _Source) -> str:
        value, kind = source.value(), source.kind
        whole = real = text = clock = "NULL"
        if kind in ("boolean", "integer"):
            whole = value
        elif isinstance(source.data_type, T.DecimalType):
            real, text = value, value
        elif kind == "decimal":
            real = value
        elif kind == "string":
            text, whole = _text_key(value), f"length({value})"
            if "dates" in asked and formats:
                clock = parse_timestamp(value, formats)
        elif kind == "datetime":
            clock = value
            if isinstance(source.data_type, T.TimestampType):
                whole = f"unix_micros({value})"
        return struct_of(
            id=str(source.id),
            whole=f"bigint({whole})",
            real=f"double({real})",
            text=f"string({text})",
            clock=f"CAST({clock} AS TIMESTAMP_NTZ)",
        )

    grouped = (
        _whole(table).selectExpr(_laid_out(sources, slots))
        .groupBy("id", "whole", "real", "text", "clock")
        .agg(F.expr("count(1)").alias("n"))
    )

    def among(wanted) -> str:
        positions = [str(s.id) for s in sources if wanted(s)]
        return f"id IN ({', '.join(positions)})" if positions else "false"

    is_text = among(lambda s: s.is_text)
    moment = day = "NULL"
    if "dates" in asked:
        moment = "clock"
        if not formats:
            parsed = parse_timestamp(f"IF({is_text}, text, NULL)")
            moment = f"coalesce(clock, {parsed})"
        from_whole = epoch_nanos_to_date("whole", whole=True)
        from_real = epoch_nanos_to_date("real", whole=False)
        numeric_day = f"coalesce({from_whole}, {from_real})"
        named = among(lambda s: s.is_date_named_number)
        day = f"coalesce(date({moment}), IF({named}, {numeric_day}, NULL))"
    # All digits of a decimal, in the order they are written.
    digits = (
        "IF(text RLIKE '^-?0E', 0, try_cast(replace(text, '.', '') AS DECIMAL(38,0)))"
    )
    return grouped.selectExpr(
        *_cell(
            "id",
            "n",
            "(whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL"
            " OR clock IS NOT NULL)",
            f"IF({among(lambda s: s.is_number)}, coalesce(real, whole), NULL)",
            f"CASE WHEN {among(lambda s: s.scale == 0 and s.kind == 'integer')} THEN whole"
            f" WHEN {among(lambda s: s.scale is not None and s.kind == 'decimal')} THEN {digits}"
            " END",
            f"IF({is_text}, whole, NULL)",
            moment,
            day,
        )
    )


def _cells(table: Table, sources: list[_Source], asked, formats) -> list[DataFrame]:
    groups: dict[str | None, list[_Source]] = {}
    for source in sources:
        groups.setdefault(_family(source, table.columnar), []).append(source)
    parts = [
        _cells_of_column(source.table, source, asked, formats)
        for source in groups.pop(None, [])
    ]
    for family, members in groups.items():
        if family == "any":
            parts.append(_cells_in_one_pass(table, members, asked, formats))
        else:
            parts.append(_cells_of_family(table, members, family, asked, formats))
    return parts


def _grouped(sources: list[_Source], asked, formats) -> DataFrame:
    """Measures with exact unique counts, from grouped values."""
    parts = []
    for table, members in _by_scan(sources):
        parts += _cells(table, members, asked, formats)
    # A zero-weight row per column keeps columns of an empty table in the result.
    spark = sources[0].table.frame.sparkSession
    anchor = spark.range(len(sources)).selectExpr("int(id) AS id")
    nulls = ["NULL"] * 5
    parts.append(anchor.selectExpr(*_cell("id", "0", "false", *nulls)))
    cells = reduce(DataFrame.unionByName, parts)
    opaque = [str(s.id) for s in sources if not s.comparable]
    unique = "count_if(present)"
    if opaque:
        unique = f"IF(id IN ({', '.join(opaque)}), NULL, {unique})"
    measures = {
        "row_count": "coalesce(sum(n), 0)",
        "non_null_count": "coalesce(sum(IF(present, n, 0)), 0)",
        "unique_count": unique,
    }
    if "numeric" in asked:
        measures["num_min"], measures["num_max"] = "min(number)", "max(number)"
        measures["num_sum"] = "sum(number * n)"
        measures["exact_min"], measures["exact_max"] = "min(exact)", "max(exact)"
        added = "try_sum(try_multiply(exact, CAST(n AS DECIMAL(20,0))))"
        measures["exact_sum"] = f"CAST({added} AS DECIMAL(38,0))"
    if "text" in asked:
        measures["len_min"], measures["len_max"] = "min(length)", "max(length)"
        measures["len_sum"] = "sum(length * n)"
    if "dates" in asked:
        measures["parsed_count"] = "coalesce(sum(IF(day IS NOT NULL, n, 0)), 0)"
        measures["moment_min"], measures["moment_max"] = "min(moment)", "max(moment)"
        measures["day_min"], measures["day_max"] = "min(day)", "max(day)"
        measures["day_count"] = "count(DISTINCT day)"
    return cells.groupBy("id").agg(*_named(measures))


def sources_of(
    tables: Iterable[Table], columns: Iterable[str] | None = None
) -> list[_Source]:
    """The columns of all tables, numbered; only those with the given names."""
    wanted = None if columns is None else set(columns)
    tables = list(tables)
    origins = [id(table.origin) for table in tables]
    # A cut whose siblings are not asked for is a table of its own, and its condition
    # reaches the scan.
    alone = [
        replace(table, origin=None, side=None) if origins.count(id(table.origin)) == 1 else table
        for table in tables
    ]
    chosen = [
        (table, position)
        for table in alone
        for position, name in enumerate(table.names)
        if wanted is None or name in wanted
    ]
    return [_Source(i, *pair) for i, pair in enumerate(chosen)]


def profiles(
    tables: Iterable[Table],
    *,
    columns: Iterable[str] | None = None,
    measures: Iterable[str] = ALL_MEASURES,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """One row of aggregates per column of every table.

    ``columns`` keeps only columns with these display names; ``measures`` keeps
    only the named groups (nulls, unique, numeric, dates, text), and what is not
    asked for is neither read nor computed: with no group only rows are counted.
    Null counts come along where a column is read anyway. The kind of a string
    column needs the 'dates' group; without it strings count as text. A column
    whose cells are not counted is never of kind 'empty'.
    """
    asked = frozenset(measures)
    if not asked <= ALL_MEASURES:
        raise ValueError(f"unknown measures: {sorted(asked - ALL_MEASURES)}")
    sources = sources_of(tables, columns)
    if not sources:
        raise ValueError("no column to profile")
    build = _grouped if "unique" in asked else _ungrouped
    return finished(described(sources, build(sources, asked, tuple(date_formats))))


def column_profile(table: Table, **options) -> DataFrame:
    """The profile of one table; options as for ``profiles``."""
    return profiles([table], **options)


#: What is known about a column without reading it, and its place in raw measures.
DESCRIPTION = {
    "dataset_id": "STRING", "position": "INT", "column_name": "STRING",
    "data_type": "STRING", "base_kind": "STRING", "is_numeric_type": "BOOLEAN",
    "scale": "INT", "name_occurrence": "INT", "name_count": "INT",
    "is_blank_name": "BOOLEAN",
}


def described(sources: list[_Source], raw: DataFrame) -> DataFrame:
    """Raw measures with the description of their columns instead of ``id``."""

    def at(values) -> str:
        return f"array({', '.join(literal(v) for v in values)})[id]"

    naming = {
        table.dataset_id: list(zip(table.occurrences(), table.blank_names()))
        for table, _ in _by_table(sources)
    }
    names = [naming[s.table.dataset_id][s.position] for s in sources]
    found = {
        "dataset_id": at([s.table.dataset_id for s in sources]),
        "position": at([s.position for s in sources]),
        "column_name": at([s.name for s in sources]),
        "data_type": at([s.data_type.simpleString() for s in sources]),
        "base_kind": at([s.kind for s in sources]),
        "is_numeric_type": at([s.is_number for s in sources]),
        "scale": f"nullif({at([-1 if s.scale is None else s.scale for s in sources])}, -1)",
        "name_occurrence": at([occurrence for (occurrence, _), _ in names]),
        "name_count": at([count for (_, count), _ in names]),
        "is_blank_name": at([blank for _, blank in names]),
    }
    measures = [name for name in raw.columns if name != "id"]
    return raw.selectExpr(*[f"{text} AS {name}" for name, text in found.items()], *measures)


def finished(raw: DataFrame) -> DataFrame:
    """Kinds and percentages around described raw measures: a column profile."""
    known = set(raw.columns)
    every = {name: type_ for group in _RAW.values() for name, type_ in group.items()}
    raw = raw.selectExpr(
        *DESCRIPTION,
        "row_count",
        "non_null_count",
        *[n if n in known else f"CAST(NULL AS {t}) AS {n}" for n, t in every.items()],
    ).selectExpr(
        "*",
        f"{pct('parsed_count', 'non_null_count')} AS parse_share",
        "row_count - non_null_count AS null_count",
        "coalesce(double(exact_sum) / power(10, scale), num_sum) AS num_added",
        "bigint(datediff(day_max, day_min)) + 1 AS dt_expected_days",
    ).selectExpr(
        "*",
        f"""CASE WHEN non_null_count = 0 THEN 'empty'
            WHEN base_kind <> 'string' THEN base_kind
            WHEN parse_share >= {DATE_PARSE_SHARE} THEN 'datetime'
            ELSE 'text' END AS inferred_kind""",
    )
    number = "inferred_kind IN ('integer', 'decimal')"
    date, text = "inferred_kind = 'datetime'", "inferred_kind = 'text'"
    found = "day_min IS NOT NULL"

    def when(condition: str, value: str, name: str) -> str:
        return f"CASE WHEN {condition} THEN {value} END AS {name}"

    return raw.selectExpr(
        "dataset_id",
        "position",
        "column_name",
        "data_type",
        "inferred_kind",
        "row_count",
        "non_null_count",
        "null_count",
        f"{pct('null_count', 'row_count')} AS null_percentage",
        "unique_count",
        f"{pct('unique_count', 'non_null_count')} AS unique_percentage",
        when(
            "unique_count IS NOT NULL",
            "greatest(non_null_count - unique_count, 0L)",
            "duplicate_value_count",
        ),
        when(number, "num_min", "num_min"),
        when(number, "num_max", "num_max"),
        when(number, "try_divide(num_added, non_null_count)", "num_mean"),
        when("is_numeric_type", "coalesce(num_added, 0.0D)", "num_total"),
        when(number, _written("exact_min"), "num_min_exact"),
        when(number, _written("exact_max"), "num_max_exact"),
        when(number, _written("exact_sum"), "num_total_exact"),
        when(date, "parsed_count", "dt_parsed_count"),
        when(date, "parse_share", "dt_parse_percentage"),
        when(date, iso_timestamp("moment_min"), "dt_min"),
        when(date, iso_timestamp("moment_max"), "dt_max"),
        f"{iso_date('day_min')} AS day_min",
        f"{iso_date('day_max')} AS day_max",
        when(found, "day_count", "dt_day_count"),
        "dt_expected_days",
        when(found, "greatest(dt_expected_days - day_count, 0L)", "dt_missing_days"),
        when(text, "len_min", "txt_min_len"),
        when(text, "len_max", "txt_max_len"),
        when(text, "try_divide(len_sum, non_null_count)", "txt_avg_len"),
        "is_numeric_type",
        "name_occurrence",
        "name_count",
        "is_blank_name",
    )


def _written(number: str) -> str:
    """A whole number of last digits with its point set; null if it is not exact."""
    digits = f"lpad(string(abs({number})), greatest(length(string(abs({number}))), scale + 1), '0')"
    point = f"substring({digits}, 1, length({digits}) - scale) || '.' || right({digits}, scale)"
    return (
        f"CASE WHEN scale = 0 THEN string({number})"
        f" WHEN scale > 0 THEN IF({number} < 0, '-', '') || {point} END"
    )


def duplicate_names(profile: DataFrame) -> DataFrame:
    """Repeated and blank display names of each profiled table."""
    return (
        profile.groupBy("dataset_id", "column_name")
        .agg(
            F.min("position").alias("position"),
            F.expr("count(1)").alias("occurrences"),
            F.expr("bool_or(is_blank_name)").alias("is_empty_name"),
            F.sum("non_null_count").alias("non_null_count"),
        )
        .filter("occurrences > 1 OR is_empty_name")
    )


def kind_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("dataset_id", "inferred_kind").agg(
        F.expr("count(1)").alias("column_count")
    )


#: Measures of a table from its columns: per column, and how they are put together.
TABLE_MEASURES = {
    "row_count": ("row_count", "max"),
    "column_count": ("1L", "sum"),
    "total_null_cells": ("null_count", "sum"),
    "columns_with_nulls": ("bigint(null_count > 0)", "sum"),
    "numeric_column_count": ("bigint(inferred_kind IN ('integer', 'decimal'))", "sum"),
    "datetime_column_count": ("bigint(inferred_kind = 'datetime')", "sum"),
    "text_column_count": ("bigint(inferred_kind = 'text')", "sum"),
    "duplicate_column_name_count": ("bigint(name_occurrence = 2)", "sum"),
    "empty_column_name_count": ("bigint(is_blank_name)", "sum"),
}


def table_measures() -> list:
    """The aggregates of a profile that is grouped by table."""
    return _named({n: f"{call}({of})" for n, (of, call) in TABLE_MEASURES.items()})


def table_summary(profile: DataFrame) -> DataFrame:
    """One row per table: shape, null cells, kinds and name problems."""
    return profile.groupBy("dataset_id").agg(*table_measures())
