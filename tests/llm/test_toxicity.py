from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from framewitness.llm import toxicity
from framewitness.llm.shared import table
from tests.llm.edge import frame, rows

SF = "/root/testdata/sf0.01"


def test_readings_compose():
    kinds = {"i": toxicity.INSULT, "t": toxicity.TARGET, "n": toxicity.NEGATION, "r": toxicity.REPORT, "k": toxicity.THREAT}

    def walk(text):
        classes = np.array([kinds.get(c, toxicity.OTHER) for c in text])
        return {r: w for r, w in enumerate(toxicity.readings(classes, np.ones(len(classes)))) if w}

    assert walk("..i") == {0: 1.0}
    assert walk("t.i") == {1: 1.0} and walk("i.t") == {1: 1.0}
    assert walk("n...i") == {4: 1.0} and walk("n......i") == {0: 1.0}
    assert walk("r....i") == {2: 1.0} and walk("i.r") == {0: 1.0}
    assert walk("rnti") == {7: 1.0} and walk("tk") == {9: 1.0}


def test_scores_follow_the_clause():
    model = toxicity.Model({"idiot$": 4.0, "lowei": 4.0})
    said = pa.array(["you idiot", "you are not an idiot", "Idiot!", "he said idiot", "nothing here", "", "ein loweich.", "idiotic"])
    plain_you, denied, plain, told, none, empty, begun, other = model.score(said)
    assert plain_you > plain > denied and plain > told and begun == plain
    assert none == empty == other < 0.5 < plain


def test_held_out_accuracy(spark):
    found = toxicity.scores(spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 40
    assert (held.predicted == held.toxic).mean() > 0.95
    assert held[held.toxic == 0].predicted.mean() < 0.02


def test_edges(spark):
    docs = frame(spark, rows())
    no_labels = spark.createDataFrame([(1, None, 7), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (no_labels, no_labels.limit(0)):
        model = toxicity.train(docs, labels)
        found = toxicity.score(docs, model).collect()
        assert len(found) == len(rows()) and all(0 <= r.score <= 1 for r in found)
        for r in found:
            key = "" if r.doc_id is None else str(r.doc_id)
            assert r.held_out == (zlib.crc32(key.encode()) % 5 == 0)
            assert r.predicted == (r.score >= 0.5)
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_stage_keeps_clean_rows(spark, tmp_path):
    bad = [(i, "you worthless idiot number %d" % i) for i in range(100, 160)]
    good = [(i, "a calm text number %d" % i) for i in range(200, 400)] + [(None, None), (401, "")]
    docs = frame(spark, bad + good)
    labels = spark.createDataFrame([(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good if i], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = toxicity.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=repr) == sorted(docs.where("doc_id is null or doc_id >= 200").collect(), key=repr)
