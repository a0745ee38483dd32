"""Exact dedup by content sort, in DataFrame functions only.

Sampled splitters range-partition the rows by their normalised bytes, Spark's external
sort places equal texts next to each other, and each row is compared in full with its
neighbour. The splitters are sampled on a bounded image of the bytes (the first 64 and
the SHA-256), so that very long texts never reach the driver.

A text in more rows than ``slice_rows`` or one in 100,000 of all rows, whichever is
more, is cut into slices by a hash of the doc_id. Fewer than 100,000 texts can be that
frequent, so their list has a proven bound and is broadcast; the slices' winners, fewer
than 300,000, are merged in a second small step.

Defined results: a null text counts as empty, an empty text equals every text of white
space alone, a null doc_id loses against any other, and of rows that agree in doc_id and
text one stays. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewitness.llm.shared import normal_spaces, parts, written

#: So many rows of one text stay together whatever the table's size.
SLICE_ROWS = 1_000
#: At most this many texts, by count, can be cut into slices.
_SLICED = 100_000


def exact_dedup(docs: DataFrame, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``row`` (a struct of all columns) and its decision: keep_id, group_size, kept and
    text_sha256."""
    spark = docs.sparkSession
    norm = normal_spaces(F.col("row.text").cast("string"))
    rows = docs.select(
        F.struct(*(docs[name] for name in docs.columns)).alias("row"),
    ).select(
        "row",
        F.encode(F.substring(norm, 1, 64), "UTF-8").alias("head"),
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
    )
    limit = max(slice_rows, docs.count() // _SLICED)
    frequent = (
        rows.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > limit)
        .select("digest", F.ceil(F.col("rows") / limit).cast("int").alias("slices"))
    )
    salt = F.when(
        F.col("slices").isNotNull(), F.pmod(F.xxhash64(F.col("row.doc_id"), F.lit(7)), F.col("slices"))
    )
    ranged = (
        rows.join(F.broadcast(frequent), "digest", "left")
        .withColumn("slice", F.coalesce(salt, F.lit(0)).cast("int"))
        .repartitionByRange(parts(spark), "head", "digest", "slice")
        .withColumn("norm", normal_spaces(F.col("row.text").cast("string")).cast("binary"))
        .withColumn("points", F.coalesce(F.length(F.col("row.text").cast("string")), F.lit(0)))
        .withColumn("id", F.col("row.doc_id").cast("long"))
    )
    near = Window.partitionBy("head", "digest", "slice").orderBy(
        "norm", F.col("points").desc(), F.col("id").asc_nulls_last()
    )
    # A run of equal neighbours; the digest only brings them together.
    begins = F.lag("norm").over(near)
    ranged = ranged.withColumn("begins", F.when(begins == F.col("norm"), 0).otherwise(1))
    ranged = ranged.withColumn("run", F.sum("begins").over(near)).drop("norm")
    within = Window.partitionBy("head", "digest", "slice", "run").orderBy(
        F.col("points").desc(), F.col("id").asc_nulls_last()
    )
    local = ranged.select(
        "row",
        "digest",
        "run",
        "slice",
        "slices",
        "points",
        "id",
        F.row_number().over(within).alias("place"),
        F.first("id").over(within).alias("best"),
        F.count(F.lit(1)).over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )
    # Written once: both the slices' winners and the decisions start from it.
    return _merged(written(local, "sorted"))


def _merged(local: DataFrame) -> DataFrame:
    """Join the slices of frequent texts; the other rows are final already."""
    sliced = F.col("slices").isNotNull()
    tops = (
        local.where(sliced & (F.col("place") == 1))
        .groupBy("digest", "run")
        .agg(
            F.sum("n").alias("all_n"),
            F.min(
                F.struct(
                    (-F.col("points")).alias("shorter"),
                    F.col("id").isNull().alias("no_id"),
                    F.col("id").alias("id"),
                    F.col("slice").alias("slice"),
                )
            ).alias("top"),
        )
    )
    joined = local.join(F.broadcast(tops), ["digest", "run"], "left")
    first = F.col("place") == 1
    return joined.select(
        "row",
        F.when(sliced, F.col("top.id")).otherwise(F.col("best")).alias("keep_id"),
        F.when(sliced, F.col("all_n")).otherwise(F.col("n")).alias("group_size"),
        F.when(sliced, first & (F.col("slice") == F.col("top.slice"))).otherwise(first).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def decisions(docs: DataFrame) -> DataFrame:
    """One row per document: the digest columns of the contract."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return exact_dedup(narrow).select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that stay, with the columns they came with."""
    return exact_dedup(docs).where("kept").select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
