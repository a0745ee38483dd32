"""Many cases over many tables, with one pass over each table's data."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.operators import checks, compare, profile, review, routing, runs
from framewitness.sources.tables import Table, table_sources


# What the outcome of a case depends on.
_CASE_KEY = ("issue_type", "dataset_id", "baseline_id")
_KEY = (*_CASE_KEY, "mentioned")


@dataclass(frozen=True)
class Investigation:
    """Lazy results: nothing runs before an output is read.

    ``reviewed`` has one row per case; the rest is cut from it. What several outputs
    need is kept by the executors from its first use on, and worked out again from the
    tables if one is lost. ``close`` releases it; the outputs stay usable.
    """

    profile: DataFrame
    comparison: DataFrame
    reviewed: DataFrame
    kept: tuple[DataFrame, ...] = field(default=(), repr=False)

    def evidence(self) -> DataFrame:
        return checks.evidence_ledger(self.reviewed)

    def hypotheses(self) -> DataFrame:
        return review.hypotheses(self.reviewed)

    def findings(self) -> DataFrame:
        return review.findings_summary(self.reviewed)

    def runs(self) -> DataFrame:
        return runs.run_manifest(self.reviewed, self.comparison)

    def sources(self) -> DataFrame:
        return compare.source_rows(self.comparison)

    def close(self) -> None:
        # The last first: what depends on a released frame would be planned again.
        for frame in reversed(self.kept):
            frame.unpersist()

    def __enter__(self) -> Investigation:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def investigate(
    cases: DataFrame,
    tables: Iterable[Table],
    pairs: Iterable[tuple[str, str]] = (),
) -> Investigation:
    """Profile the tables once, compare the pairs, and review every case.

    ``cases`` has case_id, issue_statement, dataset_id, baseline_id; ``pairs``
    names the (current, baseline) tables to compare. Profiling is the only pass
    over the data of the tables, and classifying the only pass over the
    statements. Cases with the same key share one outcome, which is worked out
    once; one plan serves any number of cases, tables and columns.
    """
    spark = cases.sparkSession
    tables = list(tables)
    known = {table.dataset_id for table in tables}
    if len(known) != len(tables):
        raise ValueError("every table needs its own dataset_id")
    pairs = list(pairs)
    unknown = {name for pair in pairs for name in pair} - known
    if unknown:
        raise ValueError(f"pairs name unknown tables: {sorted(unknown)}")
    profiled = profile.profiles(tables).persist()
    named = spark.createDataFrame(pairs, "current_id string, baseline_id string")
    compared = compare.with_sources(
        compare.compare(profiled, named), table_sources(spark, tables)
    ).persist()
    facts = checks.table_facts(profiled)
    # Kept, so that no output classifies the statements again.
    worded = checks.worded_cases(cases).persist()
    found = checks.mentioned_columns(worded, routing.folded_names(profiled)).persist()

    def keyed(of: DataFrame) -> DataFrame:
        key = F.expr(f"to_json(struct({', '.join(_KEY)}))")
        return checks.with_mentioned(of, found).withColumn("outcome_key", key)

    # What cases have in common is cut off them first. The rows of the cases are read off
    # the classified ones again by each output, which shuffles only what it shows of them.
    common = worded.select("sentence", "issue_provided", *_CASE_KEY).distinct()
    keys = keyed(common).withColumnRenamed("outcome_key", "case_id").distinct()
    outcomes = runs.with_summary(
        review.review(checks.evaluate(keys, facts, compared))
    ).persist()
    shared = outcomes.withColumnRenamed("case_id", "outcome_key").drop("issue_provided", *_KEY)
    reviewed = keyed(worded).join(shared, "outcome_key").drop("outcome_key", "mentioned")
    return Investigation(
        profiled, compared, reviewed, (profiled, compared, worded, found, outcomes)
    )
