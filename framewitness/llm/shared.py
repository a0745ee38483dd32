"""Inputs, written stages and fixed-size merges that the operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUNS: dict[str, str] = {}
_SPOTS = 1 << 15
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; other columns can't clash then."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def written(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write a derived table to the cluster's shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no earlier stage and nothing is
    worked out twice. ``release`` removes everything that a session wrote. With ``clean``
    the shuffles behind it are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    if clean:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEAN, before)
        elif clean:
            spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def removed(stage: DataFrame) -> None:
    """Remove a table that ``written`` has given and that nothing reads any more."""
    spark = stage.sparkSession
    for path in {file.rpartition("/")[0] for file in stage.inputFiles()}:
        if f"/{_folder(spark).rpartition('/')[2]}/" in path:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="framewitness-")
        _RUNS[app] = f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _RUNS[app]


def release(spark: SparkSession) -> None:
    """Remove the stages this session has written; frames read from them end with it."""
    context = spark.sparkContext
    path = None if context._jsc is None else _RUNS.pop(context.applicationId, None)
    if path:
        try:
            there = context._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)
        except Exception:  # noqa: BLE001  the session is already closing
            pass


def released(run, *forgets):
    """``run`` for mapInArrow, which gives its memory back when a task ends.

    Spark keeps Python workers for the stages that follow; what a worker holds on to, in
    tables that ``forgets`` empty and in freed blocks, adds up with theirs.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            for forget in forgets:
                forget()
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return task


def bit_filter(hashes: DataFrame, size: int) -> bytes:
    """A filter of ``size`` bits (a power of two), set at each value of the only column.

    However many values there are, the driver gets size / 8 bytes, put together in tasks
    from blocks of ``_SPOTS`` bits; ``unpacked`` turns them into an array.
    """
    place = F.col(hashes.columns[0]).bitwiseAND(F.lit(size - 1))
    block = F.shiftright(place, _SPOTS.bit_length() - 1).cast("int").alias("block")
    spot = place.bitwiseAND(F.lit(_SPOTS - 1)).cast("int").alias("spot")
    blocks = hashes.select(block, spot).distinct().groupBy("block").agg(F.collect_list("spot").alias("spots"))

    def pack(batches):
        for batch in batches:
            packed = []
            for spots in batch.column("spots").to_pylist():
                bits = np.zeros(_SPOTS, bool)
                bits[spots] = True
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], names=["block", "bits"])

    out = np.zeros((max(1, size // _SPOTS), _SPOTS // 8), np.uint8)
    for row in blocks.mapInArrow(pack, "block int, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)


def normal_spaces(text):
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
