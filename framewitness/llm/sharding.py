"""Sharding by rendezvous hashing of the document's key over weighted shards.

Each shard scores a key by ``-ln(u) / weight`` where u comes from the MD5 of key and
shard; the smallest score wins. A new shard changes no other shard's score, so it takes
rows only into itself. DataFrame functions alone; one row needs nothing but itself.

Slots number a shard's rows without gaps. Rows are spread over ``_BUCKETS`` buckets a
shard by a hash, numbered inside, and shifted by the counts of the buckets before: a
table of at most shards * ``_BUCKETS`` rows, whose size is fixed, so it is broadcast.

Defined results: a null text has no bytes and size 1, a null doc_id is a key of its own
(the text ``null``), repeated rows go to one shard and get slots of their own, an empty
table gives an empty result, other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewitness.llm.shared import only_text

SHARDS = 16
_BUCKETS = 1_024


def shard_of(key, weights: Sequence[float]):
    """The shard of a key column, among ``len(weights)`` shards."""
    scores = []
    for shard, weight in enumerate(weights):
        digest = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, 13)
        # 52 bits and a half: never 0 or 1, and exact in a double.
        share = (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        scores.append(F.struct((-F.log(share) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``grown`` is the weight of the one more shard that grown_shard counts on.
    """
    if not weights or min(*weights, grown) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    placed = only_text(docs).select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, grown]).alias("grown_shard"),
    )
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(_BUCKETS)).cast("int"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(shift), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("shift") + F.col("place") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, files: int = 8) -> None:
    """Write whole rows to one folder per shard, each of ``files`` files."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    marked = docs.withColumn("shard", shard_of(key, weights)).withColumn("_file", spread)
    marked.repartition(len(weights) * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
