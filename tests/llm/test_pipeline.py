from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from framewitness.llm import catalog
from tests.llm.edge import frame, rows

NAMES = ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "byte_bpe"]


def _words(pick, n):
    return [f"term{pick.randrange(3_000)}" for _ in range(n)]


def test_stages_work_on_what_is_kept(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    pick = random.Random(7)
    items = [(k, " ".join(_words(pick, 30))) for k in range(4)]
    clean = {100 + i: " ".join(_words(pick, 60)) for i in range(60)}
    toxic = {300 + i: " ".join([*_words(pick, 20), "you", "worthless", "idiot", *_words(pick, 20)]) for i in range(40)}
    copies = {500 + i: clean[100 + i].replace(" ", "\n") for i in range(10)}
    near = {}
    for i in range(10, 20):
        words = clean[100 + i].split()
        words[30] = "changed"
        near[600 + i] = " ".join(words)
    leaks = {700 + i: " ".join([*_words(pick, 25), items[i % 4][1], *_words(pick, 25)]) for i in range(8)}
    odd = {i: t for i, t in rows() if i in (4, 13, 14, 16, 17)}
    data = [(i, t) for some in (clean, toxic, copies, near, leaks, odd) for i, t in some.items()]
    data += [(None, None), (900, "")]
    labels = [(i, 1, int(i in toxic)) for i in (*clean, *toxic)]
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = catalog_pipeline(spark, str(tmp_path))
    # The empty text and the null one are copies; the one with a doc_id stays.
    want = {**clean, **odd, 900: ""}
    assert {r.doc_id for r in found} == set(want)
    assert len(found) == len(want)
    for r in found:
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def catalog_pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder).collect()


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
