"""Writing stage results, and cutting lineage with small written tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewitness.operators.safety import forbidden_fields, guarded


def write_stage(
    df: DataFrame, path: str, *, fmt: str = "json", by_case: bool = False
) -> None:
    """Write one stage; refuses forbidden field names, also as map keys and in JSON.

    ``by_case`` makes one folder per case and replaces the folders of the cases that
    are written, no others. That suits a few cases to hand over; with very many, leave
    it off and filter on case_id, or use ``StageStore``.
    """
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unsupported stage format: {fmt}")
    writer = _checked(df).write.mode("overwrite").format(fmt)
    if by_case:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("case_id")
    writer.save(path)


def _checked(df: DataFrame) -> DataFrame:
    found = forbidden_fields(df.schema)
    if found:
        raise ValueError(f"fields that must not be written: {', '.join(found)}")
    return guarded(df)


#: What the manifest says of a stage of a case.
MANIFEST = "stage string, case_id string, run_id string, row_count long, status string, written long"
_COMMITS = "run_id string, written long"


class StageStore:
    """Stages of many cases in one folder, safe to write again and to interrupt.

    Every write is a run with a folder of its own, which nothing overwrites. It counts
    once it is finished: first the rows are written, then one manifest row for each
    case, and last a commit of one row in one file. Runs without a commit are not seen;
    of committed ones the latest shows for each stage and case. Writing a case again so
    leaves all other cases, and what was there before shows until the new rows are whole.

    ``case_id`` may be of any type and is kept as text in the manifest.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(
        self, stage: str, rows: DataFrame, *, cases: DataFrame | None = None, status: str = "completed"
    ) -> str:
        """Write a stage and return its run; ``cases`` (case_id) may have cases without rows."""
        if not stage.replace("_", "").isalnum():
            raise ValueError(f"a stage name has letters, digits and underscores: {stage}")
        run, now = uuid.uuid4().hex, time.time_ns()
        path = f"{self.folder}/{stage}/run={run}"
        _checked(rows).write.parquet(path)
        written = self.spark.read.schema(rows.schema).parquet(path)
        counted = written.groupBy(F.col("case_id").cast("string").alias("case_id")).agg(
            F.count(F.lit(1)).alias("row_count")
        )
        if cases is not None:
            empty = cases.select(F.col("case_id").cast("string").alias("case_id"), F.lit(0).cast("long").alias("row_count"))
            counted = counted.unionByName(empty).groupBy("case_id").agg(F.sum("row_count").alias("row_count"))
        manifest = counted.select(
            F.lit(stage).alias("stage"),
            "case_id",
            F.lit(run).alias("run_id"),
            "row_count",
            F.lit(status).alias("status"),
            F.lit(now).alias("written"),
        )
        manifest.write.mode("append").parquet(f"{self.folder}/_manifest")
        self._commit(run, now)
        return run

    def _commit(self, run: str, now: int) -> None:
        commit = self.spark.range(1).select(F.lit(run).alias("run_id"), F.lit(now).alias("written"))
        commit.coalesce(1).write.mode("append").parquet(f"{self.folder}/_commits")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        conf = self.spark._jsc.hadoopConfiguration()
        if not path.getFileSystem(conf).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def manifest(self) -> DataFrame:
        """The latest committed run of each stage and case."""
        commits = self._read("_commits", _COMMITS).select("run_id")
        rows = self._read("_manifest", MANIFEST).join(commits, "run_id", "left_semi")
        latest = F.max(F.struct("written", "run_id", "row_count", "status")).alias("latest")
        return rows.groupBy("stage", "case_id").agg(latest).select("stage", "case_id", "latest.*")

    def read(self, stage: str, schema) -> DataFrame:
        """The rows of a stage, of each case those of its latest committed run."""
        mine = self.manifest().filter(F.col("stage") == stage)
        runs = mine.select(F.col("case_id").alias("own_case"), F.col("run_id").alias("own_run"))
        paths = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{stage}")
        if not paths.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(paths):
            return self.spark.createDataFrame([], schema)
        rows = (
            self.spark.read.schema(schema)
            .option("recursiveFileLookup", True)
            .parquet(f"{self.folder}/{stage}")
        )
        found = F.regexp_extract(F.col("_metadata.file_path"), "/run=([0-9a-f]+)/", 1)
        rows = rows.withColumn("row_run", found)
        here = rows["case_id"].cast("string").eqNullSafe(runs["own_case"]) & (rows["row_run"] == runs["own_run"])
        return rows.join(runs, here, "left_semi").drop("row_run")


def stage_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a derived table to a folder that all executors share, read it back.

    Later work then starts from the written rows. The caller owns the folder.
    """
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
