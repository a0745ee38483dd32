from __future__ import annotations

from framewitness.llm import toxicity


def test_repeated_ids_give_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (3, None)], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    found = toxicity._sample(docs.repartition(4), chosen).collect()
    assert sorted(found, key=repr) == sorted([(1, "text 0"), (0, "other"), (0, None)], key=repr)


def test_a_repeated_document_does_not_dominate(spark):
    base = [(i, "you are an idiot" if i % 2 else "a good day to you") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    schema = "doc_id long, text string"
    once = toxicity.train(spark.createDataFrame(base, schema), labels)
    often = toxicity.train(spark.createDataFrame(base + [base[1]] * 300, schema), labels)
    assert abs(once.bias - often.bias) < 1e-6
