"""Rows of CSV files with line breaks in cells, read by many tasks a file.

A line break ends a row exactly if an even number of quotes stands before it. Every
range of a file is read as lines; tasks number the lines of a range and keep, for both
answers to whether the range begins inside a cell, how many broken rows begin in it. The
ranges' parities, one row a range, are added up along each file, and that settles where
rows begin. Rows on one line, nearly all, never leave their task; the lines of the
others are grouped by the number of their row.

This takes files whose quotes follow RFC 4180: a quote inside a cell is doubled, and its
cell is quoted. A file with an odd number of quotes is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINES = (
    "file string, block long, line long, value string, odd boolean, parity int,"
    " begun_outside long, begun_inside long"
)


def _numbered(batches):
    """Lines with their number in the range, the parity of the quotes before them, and
    how many broken rows have begun, if the range begins outside or inside a cell."""
    here, line, parity, begun = None, 0, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        odd = (pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False) % 2).astype(np.int64)
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        size = batch.num_rows
        numbers, before = np.empty(size, np.int64), np.empty(size, np.int64)
        starts = np.empty((2, size), np.int64)
        begin = 0
        while begin < size:
            place = (files[begin], blocks[begin])
            if place != here:
                here, line, parity, begun = place, 0, 0, [0, 0]
            end = begin + 1
            while end < size and (files[end], blocks[end]) == place:
                end += 1
            run = slice(begin, end)
            added = np.cumsum(odd[run])
            before[run] = (parity + added - odd[run]) % 2
            numbers[run] = np.arange(line, line + end - begin)
            for inside in (0, 1):
                opens = odd[run] * (before[run] == inside)
                starts[inside, run] = begun[inside] + np.cumsum(opens)
                begun[inside] = int(starts[inside, end - 1])
            parity, line, begin = int((parity + added[-1]) % 2), line + end - begin, end
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"), batch.column("block"), pa.array(numbers), batch.column("value"),
                pa.array(odd.astype(bool)), pa.array(before.astype(np.int32)), pa.array(starts[0]), pa.array(starts[1]),
            ],
            names=["file", "block", "line", "value", "odd", "parity", "begun_outside", "begun_inside"],
        )


def _ranges(lines: DataFrame) -> DataFrame:
    """file, block, inside (0 or 1) and begun: what is before each range of a file."""
    totals = lines.groupBy("file", "block").agg(
        F.expr("sum(int(odd)) % 2").alias("odd"),
        F.expr("count_if(odd AND parity = 0)").alias("outside"),
        F.expr("count_if(odd AND parity = 1)").alias("inner"),
    )
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    settled = totals.withColumn("inside", F.coalesce(F.sum("odd").over(along) % 2, F.lit(0)))
    begun = F.sum(F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("inner"))).over(along)
    return settled.select(
        "file", "block", "inside", F.coalesce(begun, F.lit(0)).alias("begun"), "odd"
    )


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line and the text of every row, headers and blank rows among them.

    ``block`` and ``line`` are where a row begins: the range by its offset in the file, and
    the line in that range. Line breaks in cells become line feeds.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
        .mapInArrow(_numbered, _LINES)
    )
    ranges = _ranges(lines)
    unbalanced = ranges.groupBy("file").agg((F.sum("odd") % 2).alias("odd")).filter("odd = 1")
    if (bad := unbalanced.first()) is not None:
        raise ValueError(f"{bad['file']} has an odd number of quotes")
    placed = lines.join(ranges.drop("odd"), ["file", "block"]).selectExpr(
        "file", "block", "line", "value", "odd",
        "(parity + inside) % 2 AS before",
        "begun + IF(inside = 0, begun_outside, begun_inside) AS row",
    )
    whole = placed.filter("before = 0 AND NOT odd").select("file", "block", "line", "value")
    broken = (
        placed.filter("before = 1 OR odd")
        .groupBy("file", "row")
        .agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
        .select(
            "file",
            F.col("parts")[0]["block"].alias("block"),
            F.col("parts")[0]["line"].alias("line"),
            F.array_join(F.col("parts.value"), "\n").alias("value"),
        )
    )
    return whole.unionByName(broken)
