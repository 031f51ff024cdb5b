"""Queries and oracles of the training-data operators."""

from __future__ import annotations

from skein.llm import chat_collapse, decontaminate, embedding_dedup, langid, line_dedup, lm_score, mixing, near_dedup, substring_dedup, token_store
from skein.llm._store import tuned

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_token_store": token_store.op2_token_store,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_chat_collapse": chat_collapse.op4_chat_collapse,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_lm_score": lm_score.op10_lm_score,
}

QUERIES = {name: tuned(query) for name, query in QUERIES.items()}

ORACLES = {
    "op3_near_dedup": near_dedup.ORACLE,
    "op4_chat_collapse": chat_collapse.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_embedding_dedup": embedding_dedup.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
