"""Tables under investigation: a lazy DataFrame plus its display names.

Columns are addressed by position (c0, c1, ...), so repeated and blank display
names survive; the display names travel next to the frame as metadata.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewitness.functions.expr import quoted, struct_of
from framewitness.functions.fixed import (
    BOOLEAN_PATTERN,
    DECIMAL_PATTERN,
    INFINITY_PATTERN,
    INTEGER_PATTERN,
    NULL_TOKENS,
)
from framewitness.sources.csv_rows import csv_rows

_BLANK_NAME = re.compile(r"\s*|_c\d+|Unnamed:.*", re.DOTALL)


@dataclass(frozen=True)
class Table:
    """One table of an investigation.

    ``columnar`` says that reading one column alone is cheap (a plain parquet,
    ORC or table scan). The profiler then reads each column once, on its own;
    for anything else it reads all columns together in one pass.
    """

    dataset_id: str
    frame: DataFrame
    names: tuple[str, ...]
    source_name: str | None = None
    source_format: str = "dataframe"
    columnar: bool = False
    # The frame that this table and others are cuts of, and the column that says which
    # of its rows belong to this one.
    origin: DataFrame | None = None
    side: str | None = None

    @classmethod
    def of(cls, df: DataFrame, dataset_id: str, names=None, **source) -> Table:
        names = tuple(df.columns if names is None else names)
        if len(names) != len(df.columns):
            raise ValueError("one display name per column is needed")
        frame = df.toDF(*[f"c{i}" for i in range(len(names))])
        return cls(dataset_id, frame, names, **source)

    @classmethod
    def cuts(cls, df: DataFrame, conditions: dict[str, str | None], **source) -> tuple[Table, ...]:
        """Tables that are rows of one frame, each by a condition on its columns.

        None takes all rows; conditions may overlap. Such tables are profiled together
        in one pass over the frame, with the side as a part of the grouping key.
        """
        sides = [f"s{i}" for i in range(len(conditions))]
        flags = [
            f"{'true' if condition is None else condition} AS {side}"
            for side, condition in zip(sides, conditions.values())
        ]
        columns = [F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(df.columns)]
        origin = df.select(*columns, *[F.expr(flag) for flag in flags])
        origin = origin.filter(" OR ".join(sides))
        kept = [f"c{i}" for i in range(len(df.columns))]
        return tuple(
            cls(
                dataset_id, origin.filter(side).select(*kept), tuple(df.columns),
                origin=origin, side=side, **source,
            )
            for dataset_id, side in zip(conditions, sides)
        )

    @property
    def column_count(self) -> int:
        return len(self.names)

    def occurrences(self) -> list[tuple[int, int]]:
        """(running number, total) of each display name."""
        totals, seen, out = Counter(self.names), Counter(), []
        for name in self.names:
            seen[name] += 1
            out.append((seen[name], totals[name]))
        return out

    def blank_names(self) -> list[bool]:
        return [_BLANK_NAME.fullmatch(name) is not None for name in self.names]

    def shape(self) -> DataFrame:
        """Source metadata with the row and column count."""
        return self.frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(self.dataset_id).alias("dataset_id"),
            F.lit(self.source_name).cast("string").alias("source_name"),
            F.lit(self.source_format).alias("source_format"),
            "row_count",
            F.lit(self.column_count).cast("bigint").alias("column_count"),
        )


def table_sources(spark: SparkSession, tables) -> DataFrame:
    """dataset_id, source_name and source_format, one row per table."""
    rows = [(t.dataset_id, t.source_name, t.source_format) for t in tables]
    return spark.createDataFrame(
        rows, "dataset_id string, source_name string, source_format string"
    )


_MISFIT = "_misfit"
_END = "(end of row)"


def read_csv(
    spark: SparkSession,
    path: str,
    dataset_id: str,
    *,
    multiline: bool | str = False,
    sheet: str | None = None,
) -> Table:
    """Read CSV with a header row; null tokens and types follow pandas.

    Rows with more cells than the header are an error, and so are, unless
    ``multiline`` is given, lines with an odd number of quotes: they are parts of
    rows with line breaks in a cell. Rows with fewer cells end in nulls. Where the
    header's names are all different, every file must have the same header.

    ``multiline=True`` reads each file in one task, however its quotes are set.
    ``multiline="split"`` reads it in many, for files whose quotes follow RFC 4180.
    """
    if sheet is not None:
        raise ValueError("a sheet can only be chosen for spreadsheet input")
    _require(spark, path, ".csv")
    if multiline == "split":
        names, rows = _split_rows(spark, path)
    else:
        names, rows = _file_rows(spark, path, bool(multiline))
    torn = "0L" if multiline else _torn_lines(spark, path)
    cells = rows.toDF(*[f"c{i}" for i in range(len(names))], _MISFIT)
    table = Table.of(
        cells.drop(_MISFIT), dataset_id, names, source_name=path, source_format="csv"
    )
    # A mark behind the row's last cell falls among as many cells as the header has, and
    # one more, unless the row has more cells than the header.
    wider = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    options = "map('quote', '\"', 'escape', '\"')"
    parsed = f"from_csv({_MISFIT} || ',{_END}', '{wider}', {options})"
    marked = f"map_values(from_json(to_json({parsed}), 'map<string,string>'))"
    extra = f"NOT array_contains({marked}, '{_END}')"
    found = cells.agg(
        F.expr(_measured(table)).alias("rows"),
        F.expr(f"count_if({_MISFIT} IS NOT NULL AND {extra})").alias("wide"),
    ).first()
    if torn != "0L" and (count := torn.first()[0]):
        raise ValueError(
            f"{count} lines of {path} have an odd number of quotes; cells with line"
            " breaks need multiline=True"
        )
    if found["wide"]:
        raise ValueError(f"{found['wide']} rows of {path} have more cells than the header")
    types = {r["position"]: _inferred(r) for r in found["rows"]}
    return _with_types(table, types)


def _header_names(header) -> tuple[list[str], list[str], bool]:
    """Names as written, column names to read by, and whether those are the same."""
    names = [("" if name is None else name).removeprefix("\ufeff") for name in header]
    plain = all(names) and len({name.lower() for name in names}) == len(names)
    return names, names if plain else [f"c{i}" for i in range(len(names))], plain


def _file_rows(spark: SparkSession, path: str, multiline: bool):
    reader = spark.read.option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multiline).option("encoding", "UTF-8")
    # The header row alone, so that repeated and blank names stay as written.
    header = reader.csv(path, header=False, inferSchema=False).limit(1).first()
    if header is None:
        raise ValueError(f"no header row in {path}")
    names, columns, plain = _header_names(header)
    fields = [T.StructField(c, T.StringType()) for c in (*columns, _MISFIT)]
    rows = (
        reader.schema(T.StructType(fields))
        .option("columnNameOfCorruptRecord", _MISFIT)
        .option("enforceSchema", not plain)
        .csv(path, header=True)
    )
    return names, rows


def _split_rows(spark: SparkSession, path: str):
    rows = csv_rows(spark, path).filter("value <> ''")
    first = "block = 0 AND line = 0"
    headers = [r["value"] for r in rows.filter(first).select("value").distinct().limit(2).collect()]
    if not headers:
        raise ValueError(f"no header row in {path}")
    options = "map('quote', '\"', 'escape', '\"', 'columnNameOfCorruptRecord', '" + _MISFIT + "')"
    cells = next(csv.reader(io.StringIO(headers[0])))
    names, _, plain = _header_names(cells)
    if len(headers) > 1 and plain:
        raise ValueError(f"files of {path} have different headers")
    schema = ", ".join(f"c{i} STRING" for i in range(len(names))) + f", {_MISFIT} STRING"
    parsed = rows.filter(f"NOT ({first})").selectExpr(f"from_csv(value, '{schema}', {options}) AS r")
    return names, parsed.select("r.*")


def _torn_lines(spark: SparkSession, path: str) -> DataFrame:
    quotes = "length(value) - length(replace(value, '\"', ''))"
    return spark.read.text(path).agg(F.expr(f"count_if(({quotes}) % 2 = 1)"))


def read_parquet(spark: SparkSession, path: str, dataset_id: str) -> Table:
    """Any parquet file or folder, partitioned or not, whatever its name."""
    try:
        frame = spark.read.parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        if "PATH_NOT_FOUND" in str(error):
            raise ValueError(f"input does not exist: {path}") from error
        raise ValueError(f"unsupported extension or content, not parquet: {path}") from error
    return Table.of(
        frame, dataset_id, source_name=path, source_format="parquet", columnar=True
    )


def read_table(spark: SparkSession, name: str, dataset_id: str) -> Table:
    """A catalog table; read by column where its provider stores columns."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table does not exist: {name}")
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Provider'")
    provider = described.first()
    return Table.of(
        spark.table(name),
        dataset_id,
        source_name=name,
        source_format="table",
        columnar=provider is not None and provider["data_type"].lower() in _COLUMNAR,
    )


_COLUMNAR = ("parquet", "orc", "delta", "iceberg", "hudi")


def _require(spark: SparkSession, path: str, extension: str) -> None:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        raise ValueError(f"input does not exist: {path}") from error
    last = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + last.rsplit(".", 1)[-1].lower() if "." in last else ""
    if suffix != extension:
        found = suffix or "<none>"
        raise ValueError(f"unsupported extension '{found}', expected '{extension}'")


def _text(name: str) -> str:
    tokens = ", ".join(quoted(token) for token in NULL_TOKENS)
    return f"IF({name} IN ({tokens}), NULL, {name})"


def _measured(table: Table) -> str:
    """An aggregate: what the cells of each column of an all-text table read as."""
    structs = []
    for i, name in enumerate(table.names):
        text = _text(f"c{i}")
        whole = f"IF({text} RLIKE r'{INTEGER_PATTERN}', trim({text}), NULL)"
        unsigned = f"try_cast({whole} AS DECIMAL(20,0))"
        number = f"try_cast(IF({text} RLIKE r'{DECIMAL_PATTERN}', {text}, NULL) AS DOUBLE)"
        finite = f"coalesce(abs({number}) < double('infinity'), false)"
        structs.append(
            struct_of(
                position=str(i),
                column_name=quoted(name),
                non_null_count=f"count({text})",
                booleans=f"count_if({text} RLIKE r'{BOOLEAN_PATTERN}')",
                integers=f"count(try_cast({whole} AS BIGINT))",
                unsigneds=f"count_if({unsigned} BETWEEN 0 AND 18446744073709551615)",
                digits=f"count({whole})",
                numbers=f"count_if({finite} OR {text} RLIKE r'{INFINITY_PATTERN}')",
            )
        )
    return f"array({', '.join(structs)})"


# Whole numbers too long for 64 bits stay text, as in pandas.
_TYPES = (
    ("double", "non_null_count = 0"),
    ("boolean", "booleans = non_null_count"),
    ("bigint", "integers = non_null_count"),
    ("decimal(20,0)", "unsigneds = non_null_count"),
    ("double", "numbers = non_null_count AND digits < non_null_count"),
)


def _inferred(row) -> str:
    """The type of one column, from its row of ``_measured``."""
    cells = row["non_null_count"]
    reads = (
        cells == 0,
        row["booleans"] == cells,
        row["integers"] == cells,
        row["unsigneds"] == cells,
        row["numbers"] == cells and row["digits"] < cells,
    )
    return next((t for (t, _), fits in zip(_TYPES, reads) if fits), "string")


def type_inference(table: Table) -> DataFrame:
    """Inferred type of every column of an all-text table, from one aggregate.

    A column is boolean, bigint, decimal(20,0) or double when every non-null
    cell reads as such, else string; an all-null column is a double.
    """
    wide = table.frame.agg(F.expr(_measured(table)).alias("rows"))
    whens = " ".join(f"WHEN {condition} THEN '{name}'" for name, condition in _TYPES)
    return wide.selectExpr("inline(rows)").selectExpr(
        "position",
        "column_name",
        f"CASE {whens} ELSE 'string' END AS inferred_type",
        "non_null_count",
    )


def typed(table: Table) -> Table:
    """Apply null tokens and inferred types (one row per column is collected)."""
    rows = type_inference(table).collect()
    return _with_types(table, {r["position"]: r["inferred_type"] for r in rows})


def _with_types(table: Table, types: dict[int, str]) -> Table:
    columns = []
    for i in range(table.column_count):
        text = _text(f"c{i}")
        value = text if types[i] == "string" else f"try_cast(trim({text}) AS {types[i]})"
        columns.append(f"{value} AS c{i}")
    return replace(table, frame=table.frame.selectExpr(*columns))
