"""Queries of the operators over whole tables, and the SQL where SQL can express them."""

from __future__ import annotations

from framewitness.llm import (
    byte_bpe,
    chat_format,
    conversation_repair,
    decontaminate,
    exact_dedup,
    jaccard_join,
    line_dedup,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_codes,
)
from framewitness.llm.shared import table


def _over_documents(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": _over_documents(lambda docs: line_dedup.digests(docs, places=True)),
    "op2_suffix_dedup": _over_documents(suffix_dedup.digests),
    "op3_jaccard_join": _over_documents(jaccard_join.joined),
    "op4_decontaminate": decontaminate.over_documents,
    "op5_byte_bpe": _over_documents(byte_bpe.digests),
    "op6_token_counts": _over_documents(token_counts.token_counts),
    "op7_substring_dedup": _over_documents(substring_dedup.digests),
    "op8_sharding": _over_documents(sharding.shards),
    "op9_exact_dedup": _over_documents(exact_dedup.decisions),
    "op10_toxicity": toxicity.scores,
    "op11_conversation_repair": conversation_repair.over_conversations,
    "op12_chat_format": chat_format.over_conversations,
    "op13_vector_codes": vector_codes.over_embeddings,
}

ORACLE = {
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_chat_format": chat_format.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
