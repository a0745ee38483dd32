"""The corpus pipeline: each stage works on all that the one before has kept."""

from __future__ import annotations

from framewitness.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from framewitness.llm.shared import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontaminate", decontaminate.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: SQL can express neither the trained scores nor the joins and the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
