"""Profiles that add up: mergeable states with sketched unique counts.

Exact unique counts group every value of a column again for each snapshot. A state
keeps, for each column, what can be added instead: counts, extremes, sums, the set of
days, and a HyperLogLog sketch of the values. The state of yesterday and the state of
today's partition make the state of both, so a growing table is read once.

Building a state is one aggregate over a table: a task sends one row, whatever the
number of rows. Merging groups one row per column and state.

``unique_count`` of a finished state is an estimate. Its standard error is at most
1.04 / sqrt(2^log_size) of the true count for a merged sketch; ``unique_error`` is three
of those, which an estimate exceeds in less than 3 of 1,000 cases. All estimates are read
from the registers alone, so they don't depend on how a state was put together: halves
that are merged give the number that the whole gives.

Defined results: a state of an empty table has zero counts, columns whose values can't be
hashed (maps, variants) have a null unique count, and columns that differ in position,
name or type are different columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewitness.functions.expr import struct_of
from framewitness.operators import profile
from framewitness.sources.tables import Table

#: Registers of a sketch, as a power of two: 4 KB and 1.6 % standard error.
LOG_SIZE = 12

# How each measure of two states is put together.
_MERGED = {
    "row_count": "sum", "non_null_count": "sum", "parsed_count": "sum",
    "num_min": "min", "num_max": "max", "num_sum": "sum",
    "exact_min": "min", "exact_max": "max", "exact_sum": "try_sum",
    "len_min": "min", "len_max": "max", "len_sum": "sum",
    "moment_min": "min", "moment_max": "max",
}
_TYPES = {
    "row_count": "BIGINT", "non_null_count": "BIGINT", "parsed_count": "BIGINT",
    "num_min": "DOUBLE", "num_max": "DOUBLE", "num_sum": "DOUBLE",
    "exact_min": "DECIMAL(38,0)", "exact_max": "DECIMAL(38,0)",
    "exact_sum": "DECIMAL(38,0)", "len_min": "BIGINT", "len_max": "BIGINT",
    "len_sum": "BIGINT", "moment_min": "TIMESTAMP_NTZ", "moment_max": "TIMESTAMP_NTZ",
}


def _hashable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _hashable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_hashable(field.dataType) for field in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def state(
    table: Table, *, date_formats: tuple[str, ...] = (), log_size: int = LOG_SIZE
) -> DataFrame:
    """The state of a table: one row per column, from one pass over the table."""
    if not table.names:
        raise ValueError("no column to profile")
    sources = profile.sources_of([table])
    read, structs = [], []
    for source in sources:
        value, i = source.value(), source.position
        moment = source.moment(value, tuple(date_formats))
        read.append(f"{value} AS v{i}")
        if source.may_hold_dates:
            read += [f"{moment} AS m{i}", f"date({source.day(value, moment)}) AS d{i}"]
        value = f"v{i}"
        number, exact = source.number(value), source.exact(value)
        fields = {
            "id": str(source.id),
            "row_count": "count(1)",
            "non_null_count": f"count({value})",
            "parsed_count": f"count(d{i})" if source.may_hold_dates else "0L",
        }
        for call in ("min", "max", "sum"):
            added = "try_sum" if call == "sum" else call
            fields[f"num_{call}"] = f"{call}({number})" if source.is_number else "NULL"
            fields[f"exact_{call}"] = f"{added}({exact})" if source.scale is not None else "NULL"
            fields[f"len_{call}"] = f"{call}(length({value}))" if source.is_text else "NULL"
        for call in ("min", "max"):
            fields[f"moment_{call}"] = f"{call}(m{i})" if source.may_hold_dates else "NULL"
        typed = {n: f"CAST({t} AS {_TYPES[n]})" if n in _TYPES else t for n, t in fields.items()}
        days = f"collect_set(d{i})" if source.may_hold_dates else "array()"
        typed["days"] = f"CAST({days} AS ARRAY<DATE>)"
        hashed = f"IF({value} IS NULL, NULL, xxhash64({value}))"
        sketch = f"hll_sketch_agg({hashed}, {log_size})" if _hashable(source.data_type) else "NULL"
        typed["unique_sketch"] = f"CAST({sketch} AS BINARY)"
        structs.append(struct_of(**typed))
    wide = table.frame.selectExpr(*read).agg(F.expr(f"array({', '.join(structs)})").alias("rows"))
    return profile.described(sources, wide.selectExpr("inline(rows)"))


def merged(states: Iterable[DataFrame]) -> DataFrame:
    """The state of all tables together; columns are the same if all about them is."""
    rows = reduce(DataFrame.unionByName, states)
    measures = [
        F.expr(f"CAST({call}({name}) AS {_TYPES[name]})").alias(name)
        for name, call in _MERGED.items()
    ]
    return rows.groupBy(*profile.DESCRIPTION).agg(
        *measures,
        F.expr("array_distinct(flatten(collect_list(days)))").alias("days"),
        F.expr("IF(count(unique_sketch) = 0, NULL, hll_union_agg(unique_sketch))").alias(
            "unique_sketch"
        ),
    )


def finished(states: DataFrame) -> DataFrame:
    """The column profile of a state, with ``unique_error`` for its estimates.

    A sketch is first united with itself: what is left are its registers, and the
    estimate no longer depends on the order in which values came.
    """
    settled = "hll_sketch_estimate(hll_union(unique_sketch, unique_sketch))"
    raw = states.selectExpr(
        *profile.DESCRIPTION,
        *_MERGED,
        f"IF(unique_sketch IS NULL, NULL, least({settled}, non_null_count)) AS unique_count",
        "array_min(days) AS day_min",
        "array_max(days) AS day_max",
        "bigint(size(days)) AS day_count",
    )
    return profile.finished(raw)


def unique_error(log_size: int = LOG_SIZE) -> float:
    """Three standard errors of an estimate, as a share of the true count."""
    return 3 * 1.04 / 2 ** (log_size / 2)
