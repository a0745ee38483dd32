"""Stages that can be written again and interrupted; status from what is stored."""

from __future__ import annotations

import pytest
from helpers import cases

from framewitness.operators import runs
from framewitness.sources import StageStore, write_stage

SCHEMA = "case_id int, check_id string"


def read(store, stage="evidence"):
    return sorted(((r.case_id, r.check_id) for r in store.read(stage, SCHEMA).collect()), key=repr)


def test_writing_a_case_leaves_the_others(spark, tmp_path):
    out = str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "a")], [(2, "b")], [(3, "c")]):
        write_stage(spark.createDataFrame(rows, SCHEMA), out, by_case=True)
    found = sorted((r.case_id, r.check_id) for r in spark.read.json(out).collect())
    assert found == [(1, "a"), (2, "b"), (3, "c")]


def test_latest_run_of_each_case_shows(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "store"))
    assert read(store) == [] and store.manifest().count() == 0
    store.write("evidence", spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], SCHEMA))
    store.write("evidence", spark.createDataFrame([(2, "c"), (None, "d")], SCHEMA))
    assert read(store) == [(1, "a"), (1, "b"), (2, "c"), (None, "d")]
    # A case without rows replaces what it had.
    only = spark.createDataFrame([(1,)], "case_id int")
    store.write("evidence", spark.createDataFrame([], SCHEMA), cases=only)
    assert read(store) == [(2, "c"), (None, "d")]
    counts = {(r.stage, r.case_id): r.row_count for r in store.manifest().collect()}
    assert counts == {("evidence", "1"): 0, ("evidence", "2"): 1, ("evidence", None): 1}
    with pytest.raises(ValueError):
        store.write("../x", only)
    with pytest.raises(ValueError, match="top_values"):
        store.write("x", spark.sql("SELECT 1 AS case_id, 2 AS top_values"))


@pytest.mark.parametrize("broken", ["rows", "manifest"])
def test_a_run_that_was_interrupted_is_not_seen(spark, tmp_path, broken, monkeypatch):
    store = StageStore(spark, str(tmp_path / "store"))
    store.write("evidence", spark.createDataFrame([(1, "a")], SCHEMA))
    if broken == "rows":
        spark.createDataFrame([(1, "x")], SCHEMA).write.parquet(f"{store.folder}/evidence/run=abc")
    else:
        monkeypatch.setattr(store, "_commit", lambda *_: None)
        store.write("evidence", spark.createDataFrame([(1, "x"), (2, "x")], SCHEMA))
    assert read(store) == [(1, "a")]
    assert [(r.case_id, r.row_count) for r in store.manifest().collect()] == [("1", 1)]


def test_status_of_what_is_stored(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "store"))
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "case_id int")
    store.write("evidence", one(1, 2, 3, 4, 5, 7))
    for stage, ids in ("hypotheses", (2, 3, 4, 5)), ("findings", (3, 4, 5)), ("report", (4, 5)):
        store.write(stage, one(*ids))
    store.write("notes", one(5))
    store.write("notes", one(4), status="failed")
    rows = cases(spark, *[("Nulls appeared", "t", None)] * 6, ("Nulls appeared", None, None), (None, "t", None))
    found = {r.case_id: (r.status, r.stage) for r in runs.stored_status(rows, store.manifest()).collect()}
    names = ("profiled", "evidence", "evidence", "findings", "notes_failed", "notes", "planned", "missing")
    assert found == {i: runs.RUN_STAGES[name] for i, name in enumerate(names)}
