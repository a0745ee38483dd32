from __future__ import annotations

import pyarrow as pa

from framewitness.llm import byte_bpe
from framewitness.llm.shared import released


def test_workers_keep_no_ids_between_tasks(spark):
    """Reused Python workers held the ids of up to 500,000 matches through later stages."""

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(byte_bpe.load().kept)], pa.int64())})

    docs = spark.range(0, 200, numPartitions=8).selectExpr(
        "id AS doc_id", "array_join(transform(sequence(1, 50), i -> 'w' || id || 'x' || i), ' ') AS text"
    )
    assert byte_bpe.digests(docs).where("n_tokens > 0").count() == 200
    assert {r.n for r in spark.range(0, 64, numPartitions=16).mapInArrow(kept, "n long").collect()} == {0}


def test_a_task_gives_its_rows_and_then_forgets():
    told = []

    def run(batches):
        for batch in batches:
            told.append("row")
            yield batch

    assert list(released(run, lambda: told.append("forgot"))([1, 2])) == [1, 2]
    assert told == ["row", "row", "forgot"]
    part = released(run, lambda: told.append("forgot"))([1, 2])
    next(part)
    part.close()  # a limit further up ends a task early
    assert told[3:] == ["row", "forgot"]
